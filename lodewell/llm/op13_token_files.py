"""Token files: every document's ids in ORC, in ascending order of the ids of the documents.

Texts are shuffled once, by ranges of (doc_id, hash of the text, position), so that a hot or missing
id is dealt over several files; each task encodes one sorted range and writes one file. A row of a
file holds its `part` (the file's number), `at` (ids of this file before it), `doc_id`, `n_tokens`
and `ids`. ORC run-length encodes the integers; its stripes are what readers split on, the row
indexes and the statistics of stripes prune by `doc_id`, `part` and `at`, and Bloom filters on
`doc_id` prune look-ups of single documents. Global positions are `at` plus the sum of the files
before, a table of one row for each file.

Ids are those that the `tokenizers` library gives for the whole text. Where the vocabulary lower-cases,
splits by the pattern WORDS, a stretch of Latin letters between other ASCII characters always is a
word of its own, so each distinct stretch is encoded once and its ids are looked up afterwards;
texts with special tokens, and all texts of other vocabularies, are encoded whole.

Null texts are empty: they have the end id alone. Null document ids stand before all others. Repeated
rows are encoded each; they stand next to each other. A text is one row of a file whatever its length
(of 2 GB at most, as everywhere in Spark). An empty table gives no file and no row. Columns other than
the id and the text play no part, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import LOWER, byte_view, chunks, keyed_texts, lookup, shared_dir, table

END_ID = 2
#: Most and least bytes of text for a file; between them, four files for each core.
FILE_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
STRIPE_BYTES, STRIDE = 8 << 20, 1000
#: Rows that ORC's writer and reader hold at a time, and after which the writer looks whether a stripe is full.
ORC_ROWS = 128
#: Bytes of text that are encoded at a time; a longer text is taken alone.
CHUNK = 3 << 20
#: Distinct stretches that an encoder remembers; beyond it forgets all and goes on.
REMEMBERED = 400_000
#: Stretches that are handed to the library in one text.
TOGETHER = 1000

#: The pre-tokenisation pattern and the normalisers of vocabularies whose words are known to be separable.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]

SPACE = lookup(lambda c: c in (9, 10, 11, 12, 13, 32))
LETTER = lookup(lambda c: 65 <= c <= 90 or 97 <= c <= 122)
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is LATIN; normal forms leave them as they are unless a mark follows.
LATIN, SECOND = 0xC3, lookup(lambda c: 0x80 <= c <= 0xBF and c not in (0x97, 0xB7))
#: What may stand before a stretch of letters that is a word of its own: ASCII, but no apostrophe, which takes letters with it.
BEFORE = lookup(lambda c: c < 128 and c != 39)
AFTER = lookup(lambda c: c < 128)


class Encoder:
    """Ids of whole texts by the vocabulary at `path`, for Arrow batches of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        state = lambda part: json.loads(part.__getstate__()) if part else {}
        patterns = [(x.get("pattern") or {}).get("Regex") for x in state(self.library.pre_tokenizer).get("pretokenizers", ())]
        normalisers = [x["type"] for x in state(self.library.normalizer).get("normalizers", ())]
        special = {i: x.content for i, x in self.library.get_added_tokens_decoder().items()}
        self.special = [x.encode() for x in special.values()]
        self.separable = bool(special) and WORDS in patterns and normalisers == NORMALISERS and getattr(self.library.model, "end_of_word_suffix", None) == "</w>"
        if self.separable:
            self.parting, self.between = max(special.items())  # no stretch has this id
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each), by the library on the texts as they are."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def learn(self, new: list[str]) -> None:
        """Encodes stretches that are not known yet: a word of letters is what the model itself takes, others are parted by a special token in one text."""
        plain, others = [], []
        for x in new:
            (plain if x.isalpha() and x.isascii() else others).append(x)
        self.known.update(zip(chain(plain, others), range(len(self.known), len(self.known) + len(new))))
        model = self.library.model.tokenize
        found = [[token.id for token in model(x.lower())] for x in plain]  # a last letter may have kept its case
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        more, _ = self.whole([self.between.join(others[i : i + TOGETHER]) + self.between for i in range(0, len(others), TOGETHER)])
        parted = more == self.parting
        more_counts = np.diff(np.append(-1, np.flatnonzero(parted))) - 1
        self.ids = np.concatenate([self.ids, ids, more[~parted]])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate([counts, more_counts]))])

    def stretches(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The texts' words of letters and what stands between them, without white space, and the number of each text."""
        marked = np.append(raw[1:] >= 128, False)  # a mark may follow, which composes with one case of the letter alone
        raw = np.where(marked, raw, LOWER[raw])
        letter, begins = LETTER[raw], np.zeros(len(raw) + 1, bool)
        two = np.flatnonzero((raw[:-1] == LATIN) & SECOND[raw[1:]])
        letter[two] = letter[two + 1] = True
        begins[offsets] = True
        edge = begins.copy()  # where another stretch may begin: texts, changes between letters and others, and after white space
        edge[1:-1] |= (letter[1:] != letter[:-1]) | SPACE[raw[:-1]]
        at = np.flatnonzero(edge[:-1])
        end = np.append(at[1:], len(raw))
        word = letter[at] & (begins[at] | BEFORE[raw[at - 1]]) & (begins[end] | AFTER[raw[np.minimum(end, len(raw) - 1)]])
        # an edge counts if it parts a word of its own from something, or stands at a text's begin or after white space
        cut = np.zeros(len(raw) + 1, bool)
        cut[at[word]] = cut[end[word]] = True
        cut |= begins
        cut[1:-1] |= SPACE[raw[:-1]]
        kept = ~SPACE[raw]
        starts = np.flatnonzero(cut[:-1] & kept)
        data, place = raw[kept], np.cumsum(kept, dtype=np.int32) - kept
        spans = np.append(place[starts], len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(spans), pa.py_buffer(data)), np.diff(np.searchsorted(starts, offsets))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each)."""
        raw, offsets = byte_view(texts)
        if not self.separable or not len(raw):
            return self.whole([x or "" for x in texts.to_pylist()])
        if any(x in raw.tobytes() for x in self.special):
            each = [self(texts.slice(i, 1)) if len(texts) > 1 else self.whole([texts[0].as_py()]) for i in range(len(texts))]
            return np.concatenate([ids for ids, _ in each]), np.concatenate([n for _, n in each])
        words, counts = self.stretches(raw, offsets)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([x for x in distinct if x not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        lengths = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(lengths)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[at] - (ends - lengths), lengths)
        per_text = np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])
        return self.ids[taken], per_text


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's, and the offsets of the texts."""
    offsets = np.append(0, np.cumsum(counts + 1))
    out = np.full(offsets[-1], end_id, np.int32)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = ids
    return out, offsets


FILE = "part int, at long, doc_id long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, stripe_bytes: int = STRIPE_BYTES) -> str:
    """Writes the token files of docs to the folder `path`, which must not be there yet, and returns it."""
    keyed, cores = keyed_texts(docs, id_col, text_col), docs.sparkSession.sparkContext.defaultParallelism
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // max(LEAST_BYTES, min(file_bytes, total // (4 * cores)))))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_place")]
    ranges = keyed.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        encode, part, at = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in chunks(batch, limit=CHUNK, most=1 << 14):
                ids, offsets = with_ends(*encode(rows.column(1)), end_id)
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(at + offsets[:-1]), rows.column(0), pa.array(np.diff(offsets)), values],
                    names=[x.split()[0] for x in FILE.split(", ")],
                )
                at += len(ids)

    few_rows(docs.sparkSession)
    options = {"orc.rows.between.memory.checks": ORC_ROWS, "orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.stripe.size": stripe_bytes, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ranges.select("doc_id", "text").mapInArrow(run, FILE).write.options(**options).orc(path, compression="zstd")
    return path


def files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: part, base (ids of all files before it), size, and the range of its documents' ids. Reads no token."""
    each = rows(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return each.withColumn("base", F.sum("size").over(Window.orderBy("part")) - F.col("size"))


def few_rows(spark: SparkSession) -> None:
    """Has Spark write and read ORC in batches of few rows, as a row may hold many tokens; session settings."""
    spark.conf.set("spark.sql.orc.columnarWriterBatchSize", ORC_ROWS)
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", 2 * ORC_ROWS)


def rows(spark: SparkSession, path: str) -> DataFrame:
    few_rows(spark)
    return spark.read.schema(FILE).orc(path)


def placed(found: DataFrame, path: str) -> DataFrame:
    """Rows with `start`, the ids of all documents before; the table of files has one row for each 128 MB of text or so, hence the broadcast."""
    bases = files(found.sparkSession, path).select("part", "base")
    return found.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("at")).drop("base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document: doc_id, start, n_tokens, ids. Spark splits the files by stripes."""
    return placed(rows(spark, path), path).select("doc_id", "start", "n_tokens", "ids")


def lookup_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of the given ids: the filter reaches the files, whose statistics and Bloom filters leave out stripes without them."""
    return placed(rows(spark, path).filter(F.col("doc_id").isin(doc_ids)), path).select("doc_id", "start", "n_tokens", "ids")


def span(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The ids at positions start .. start + length - 1 of the whole sequence, as pieces (doc_id, position, ids) of documents.

    Of the table of files only those that hold such positions are looked at; their numbers and places are filters that reach the files.
    """
    hit = [(r["part"], start - r["base"]) for r in files(spark, path).filter((F.col("base") < start + length) & (F.col("base") + F.col("size") > start)).collect()]
    inside = F.lit(False)
    for part, low in hit:
        inside = inside | ((F.col("part") == part) & (F.col("at") < low + length) & (F.col("at") + F.col("n_tokens") > low))
    found = placed(rows(spark, path).filter(F.col("part").isin([p for p, _ in hit])).filter(inside), path)
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    last = F.least(F.lit(start + length) - F.col("start"), F.col("n_tokens"))
    return found.select("doc_id", (F.col("start") + first).alias("position"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"))


def checksums(found: DataFrame) -> DataFrame:
    """part, at, doc_id, n_tokens and ids_crc32, from the ids that were read: their little-endian 32-bit form."""

    def run(batches):
        for batch in batches:
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    return found.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")


def vocabulary_path() -> str:
    """Where the installed package of public vocabularies keeps the tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tables/tokens-{uuid.uuid4().hex}", vocabulary_path())
    return placed(checksums(rows(spark, path)), path).select("doc_id", "start", "n_tokens", "ids_crc32")
