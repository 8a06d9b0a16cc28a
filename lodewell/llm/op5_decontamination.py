"""Benchmark decontamination: an FM-index over each shard of training text, searched for test phrases.

A shard is the texts that a task holds at a time. Its words become numbers, those of no test phrase
separators; stretches between separators that are shorter than the shortest phrase hold no
occurrence and are left out. Over the rest stand a suffix array, the Burrows-Wheeler transform in
a wavelet matrix, and sampled suffix positions. All phrases are searched backward in step; their
occurrences are located by walking to the next sample, and their spans are merged.

Phrases are windows of WINDOW consecutive words of a test item, or all words of a shorter one.
Null and empty texts have no words; an item without words has no phrase. Repeated rows are judged
one by one. Tests are read in blocks of BLOCK_WORDS, so each broadcast has a bound; a task holds
one block of several at a time, with HELD_BYTES of text, and the text is scanned once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import LOWER, bounded_batches, byte_view, chunks, keyed_texts, lookup, plain_names, span_hashes, table, unkept, word_spans

WINDOW = 13
#: Words of test items that are searched in one pass over the text; each takes about 120 bytes as phrases.
BLOCK_WORDS = 500_000
#: Text that is searched for one block after the other, if there are several.
HELD_BYTES = 32 << 20
#: Text of one shard, and the distance between sampled suffix positions.
SHARD_BYTES, SHARD_DOCS, SAMPLED = 1 << 20, 4096, 8

_WORD = lookup(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes of the array) of each word, and the number of words in each text; A-Z are lower-cased."""
    data, offsets = byte_view(texts)
    low = LOWER[data]
    starts, ends, count = word_spans(_WORD[low], offsets)
    return span_hashes(low, starts, ends), starts, ends, count


def phrases(items: list[tuple[int, str]], window: int = WINDOW) -> dict:
    """Distinct windows as rows of word numbers, and which items have them.

    `vocabulary` holds the words' hashes in order, a word's number is its place plus 1; `rows` is
    filled with 0 on the left, so that backward search begins at the right end for all.
    """
    ids = [i for i, _ in items]
    hashes, _, _, count = words_of(pa.array([t for _, t in items], pa.string()))
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    numbers = numbers + 1
    found: dict = {}
    at = 0
    for item, n in zip(ids, count.tolist()):
        own = numbers[at : at + n].tolist()
        at += n
        for i in range(max(1, n - window + 1) if n else 0):
            found.setdefault(tuple(own[i : i + window]), set()).add(item)
    rows = np.zeros((len(found), window), np.int64)
    for k, phrase in enumerate(found):
        rows[k, window - len(phrase) :] = phrase
    owners = [sorted(x) for x in found.values()]
    return {
        "vocabulary": vocabulary,
        "rows": rows,
        "length": np.array([len(p) for p in found], np.int64),
        "owners": np.array([i for x in owners for i in x], np.int64),
        "owners_at": np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64),
    }


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; only those that are still tied are sorted again."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # a rank is the place of the first suffix that is equal so far
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        tied = ~(first & np.concatenate([first[1:], [True]]))
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        some = order[places]
        follow = np.where(some + step < n, rank[np.minimum(some + step, n - 1)], -1)
        own = rank[some]
        again = np.lexsort((follow, own))
        some, own, follow = some[again], own[again], follow[again]
        order[places] = some
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        first[places] = new
        rank[some] = np.maximum.accumulate(np.where(new, places, 0))
        step *= 2


class WaveletMatrix:
    """Counts of a symbol before a place, for many symbols and places at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (now >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
            zeros = len(now) - int(before[-1])
            self.levels.append((bit, before, zeros))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low = np.zeros_like(place)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            place, low = np.where(one, zeros + before[place], place - before[place]), np.where(one, zeros + before[low], low - before[low])
        return place - low


class FMIndex:
    """Over a text of numbers from 1 on, with 0 for separators, which end all matches; the text begins and ends with one."""

    def __init__(self, text: np.ndarray, sampled: int = SAMPLED):
        separators = np.cumsum(text == 0)
        distinct = np.where(text == 0, separators, text + separators[-1])  # no suffix runs on past a separator
        order = suffix_array(distinct)
        self.last = text[order - 1]
        self.size = len(text)
        top = int(text.max(initial=0))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.top = top
        self.ranks = WaveletMatrix(self.last, max(1, top.bit_length()))
        kept = (order % sampled == 0) | (self.last == 0)  # walks end at a stretch's first word at the latest
        self.kept, self.kept_before, self.positions = kept, np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; rows end at the right and are filled with 0."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.size, np.int64)
        high[(rows > self.top).any(axis=1)] = 0
        for step in range(1, rows.shape[1] + 1):
            on = np.flatnonzero((step <= length) & (low < high))
            if not len(on):
                break
            symbol = rows[on, -step]
            low[on] = self.below[symbol] + self.ranks.rank(symbol, low[on])
            high[on] = self.below[symbol] + self.ranks.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        found, walked = np.zeros(len(places), np.int64), 0
        on, at = np.arange(len(places)), places
        while len(on):
            here = self.kept[at]
            found[on[here]] = self.positions[self.kept_before[at[here]]] + walked
            on, at = on[~here], at[~here]
            symbol = self.last[at]
            at = self.below[symbol] + self.ranks.rank(symbol, at)
            walked += 1
        return found


def occurrences(texts: pa.Array, tests: dict) -> tuple[np.ndarray, list, list]:
    """For each text: its number of words, the merged spans of words (first, end) in occurrences, and the items that occur."""
    hashes, _, _, count = words_of(texts)
    spans: list = [[] for _ in range(len(count))]
    items: list = [[] for _ in range(len(count))]
    if not len(tests["length"]) or not len(hashes):
        return count, spans, items
    place = np.minimum(np.searchsorted(tests["vocabulary"], hashes), len(tests["vocabulary"]) - 1)
    number = np.where(tests["vocabulary"][place] == hashes, place + 1, 0)
    # stretches of phrase words within a text, as long as the shortest phrase
    starts, ends, _ = word_spans((number > 0).view(np.uint8), np.concatenate([[0], np.cumsum(count)]))
    long = ends - starts >= tests["length"].min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return count, spans, items
    size = ends - starts
    begin = np.cumsum(np.concatenate([[1], size[:-1] + 1]))  # a separator before each stretch
    text = np.zeros(int(begin[-1] + size[-1]) + 1, np.int64)
    word = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text_at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text[text_at] = number[word]
    origin = np.full(len(text), -1, np.int64)
    origin[text_at] = word
    index = FMIndex(text)
    low, high = index.search(tests["rows"], tests["length"])
    some = np.flatnonzero(low < high)
    many = high[some] - low[some]
    phrase = np.repeat(some, many)
    if not len(phrase):
        return count, spans, items
    positions = index.locate(np.repeat(low[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()))
    begins = origin[positions]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + tests["length"][phrase], -1)
    first_word = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(*word_spans((np.cumsum(change[:-1]) > 0).view(np.uint8), first_word)[:2]):
        doc = int(np.searchsorted(first_word, a, side="right")) - 1
        spans[doc].append((int(a - first_word[doc]), int(b - first_word[doc])))
    docs = np.searchsorted(first_word, begins, side="right") - 1
    for doc, p in np.unique(np.stack([docs, phrase], axis=1), axis=0):
        items[doc] += tests["owners"][tests["owners_at"][p] : tests["owners_at"][p + 1]].tolist()
    return count, spans, [sorted(set(x)) for x in items]


def merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_blocks(tests: DataFrame, block_words: int = BLOCK_WORDS):
    """Blocks of (item_id, text), each of about `block_words` words at most, told by their length in bytes."""
    rows = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (block_words * 4)) or 1
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def searcher(spark: SparkSession, tests: DataFrame, window: int, block_words: int):
    """A function that turns an iterator of batches into (part, occurrences of its column `text`) for every chunk of them."""
    blocks = [spark.sparkContext.broadcast(phrases(block, window)) for block in test_blocks(tests, block_words)]

    def held(batches):
        parts, size = [], 0
        for batch in batches:
            for part in chunks(batch, limit=SHARD_BYTES, most=SHARD_DOCS):
                parts.append(part)
                size += len(byte_view(part.column(part.schema.get_field_index("text")))[0])
                if size >= HELD_BYTES or len(blocks) == 1:
                    yield parts
                    parts, size = [], 0
        yield parts

    def run(batches):
        for parts in held(batches):
            found: list = [None] * len(parts)
            for block in blocks if parts else []:
                phrases_ = block.value if len(blocks) == 1 else unkept(block)
                for k, part in enumerate(parts):
                    new = occurrences(part.column(part.schema.get_field_index("text")), phrases_)
                    found[k] = new if found[k] is None else joined(found[k], new)
            yield from zip(parts, found)

    return run


def joined(a: tuple, b: tuple) -> tuple:
    """Occurrences of two blocks of tests in the same texts, as those of one block."""
    return a[0], [merged(x + y) if x and y else x or y for x, y in zip(a[1], b[1])], [sorted({*x, *y}) for x, y in zip(a[2], b[2])]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
STATE = "doc_id long, text string, n_words long, spans array<struct<first:long,end:long>>, items array<long>"


def find(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans of words to remove (first, end), and the items that occur; one scan, no shuffle."""
    search = searcher(docs.sparkSession, tests, window, block_words)

    def run(batches):
        for part, (count, spans, items) in search(batches):
            structs = pa.array([[{"first": x, "end": y} for x, y in s] for s in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count, pa.int64()), structs, pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "n_words", "spans", "items"])

    return keyed_texts(docs).mapInArrow(run, STATE)


def contaminated():
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


N_HIT = "aggregate(spans, 0L, (n, s) -> n + s.end - s.first)"


def keep(docs: DataFrame, tests: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that are not contaminated, with all their columns, judged in the same scan, however many blocks there are."""
    bounded_batches(docs.sparkSession)
    docs, names = plain_names(docs)
    search = searcher(docs.sparkSession, tests, WINDOW, block_words)

    def run(batches):
        for part, (count, spans, _) in search(batches):
            hit = np.array([sum(b - a for a, b in s) for s in spans])
            yield part.filter(pa.array((hit == 0) | (20 * hit < count)))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def without_spans(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans or text is None:
        return text
    _, starts, ends, _ = words_of(pa.array([text]))
    data, out, at = text.encode(), [], 0
    for first, end in spans:
        out.append(data[at : starts[first]])
        at = int(ends[end - 1])
    return b"".join([*out, data[at:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    as_text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    digest = found.select("doc_id", "n_words", F.expr(N_HIT).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(as_text.cast("binary"), 256).alias("items_sha256"))
    return digest.withColumn("contaminated", contaminated())


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM phrases
), windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, windows.n AS n, item_id FROM windows JOIN phrases ON windows.phrase = phrases.phrase AND windows.n = phrases.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
