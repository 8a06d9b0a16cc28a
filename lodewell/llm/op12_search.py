"""Ranked lexical search: an index of document shards with postings in CSR form and integer impacts.

A shard is a run of texts of SHARD_BYTES in one task, one row of the index: its terms, where each
term's postings begin, the postings' documents (places in the shard) and impacts, and the documents'
ids. Impacts are integers that hold all but the term's weight, so the counts that they depend on
(documents with terms, terms in all) are taken first, in a pass that keeps two numbers for each task.

A search takes its queries in blocks of BLOCK_BYTES of text, each broadcast once. One pass over the
terms alone sums in how many documents each term of the queries is; the next one adds, shard by shard
and term by term, weight times impact into a dense array of the shard's documents, finds the k-th
score by argpartition, keeps what reaches it, ties included, and cuts them by document id. Tasks keep
k rows for each query, which are merged in salted groups and then by query.

Null and empty texts have no terms: they are in no count and no result. Repeated rows are documents of
their own. Documents without id count as all others do and come last among equal scores. Queries of
one id are one query of all their terms, those without id together; a query without terms, or of terms
that no document has, has no rows. A text longer than a shard is a shard alone. Empty tables give no
rows. Columns other than ids and texts play no part.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import LOWER, byte_view, chunks, keyed_texts, lookup, shared_dir, table, unkept, word_spans

TOP = 10
#: Text and documents of a shard, text of the queries in one block, and groups that the best of tasks are merged in first.
SHARD_BYTES, SHARD_DOCS, BLOCK_BYTES, SALTS = 12 << 20, 1 << 16, 2 << 20, 32
#: The index is written in row groups of a few shards, so that readers hold few of them.
GROUP_BYTES = 16 << 20

_WORD = lookup(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)

INDEX = "n_docs int, ids binary, no_id binary, terms array<string>, begins binary, docs binary, impacts binary"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after another, and the number of terms in each text."""
    data, offsets = byte_view(texts)
    low = LOWER[data]
    word = _WORD[low]
    starts, ends, count = word_spans(word, offsets)
    spans = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(spans), pa.py_buffer(low[word])), count


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term of frequency tf in a document of n terms adds to a score, but for the term's weight."""
    longer = 10 + (90 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * longer)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def shard(parts: list[pa.RecordBatch], documents: int, total: int) -> list:
    """A row of the index."""
    counts, vocabulary, codes = [], pa.array([], pa.string()), []
    pieces = []
    for part in parts:
        terms, count = terms_of(part.column(1))
        pieces.append(terms.dictionary_encode())
        counts.append(count)
    coded = pa.chunked_array(pieces).unify_dictionaries() if pieces else None
    vocabulary = coded.chunk(coded.num_chunks - 1).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    n = np.concatenate(counts)
    key = codes * len(n) + np.repeat(np.arange(len(n)), n)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    term, doc = np.divmod(key[first], max(len(n), 1))
    ids = pa.chunked_array([p.column(0) for p in parts]).combine_chunks()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    begins = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    worth = impact(tf, n[doc], documents, max(total, 1))
    return [len(n), ids.fill_null(0).to_numpy().tobytes(), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), vocabulary, begins.astype("<i8").tobytes(), doc.astype("<i4").tobytes(), worth.astype("<i4").tobytes()]


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and terms in all, with repeats."""

    def run(batches):
        documents = total = 0
        for batch in batches:
            for rows in chunks(batch):
                data, offsets = byte_view(rows.column(0))
                count = word_spans(_WORD[LOWER[data]], offsets)[2]
                documents, total = documents + int((count > 0).sum()), total + int(count.sum())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "total": [total]}, pa.schema([("documents", pa.int64()), ("total", pa.int64())]))

    found = docs.select("text").mapInArrow(run, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> str:
    """Writes the index of docs to the folder `path`, which must not be there yet, and returns it. Texts are read twice and not shuffled."""
    keyed = keyed_texts(docs, id_col, text_col)
    documents, total = corpus_counts(keyed)

    def row(parts):
        cells = shard(parts, documents, total)
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        cells[3] = pa.ListArray.from_arrays(pa.array([0, len(cells[3])], pa.int32()), cells[3])
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array([c], k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches):
        parts, size, n = [], 0, 0
        for batch in batches:
            for rows in chunks(batch, limit=min(1 << 20, shard_bytes), most=shard_docs):
                more = len(byte_view(rows.column(1))[0])
                if parts and (size + more > shard_bytes or n + rows.num_rows > shard_docs):
                    yield row(parts)
                    parts, size, n = [], 0, 0
                parts.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.columns], names=rows.schema.names))
                size, n = size + more, n + rows.num_rows
        if parts:
            yield row(parts)

    spark = docs.sparkSession
    options = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}
    keyed.mapInArrow(run, INDEX).write.options(**options).parquet(f"{path}/shards", compression="zstd")
    spark.createDataFrame([(documents, total)], "documents long, total long").coalesce(1).write.parquet(f"{path}/counts")
    return path


def query_blocks(queries: DataFrame, id_col: str, text_col: str):
    """Blocks of queries as {"terms": their distinct terms, "ids", "begins", "numbers": each query's terms as places in that list}."""
    rows = keyed_texts(queries, id_col, text_col).where("text IS NOT NULL").distinct()
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) or 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        batch = block.to_batches()[0]
        terms, count = terms_of(batch.column(1))
        coded = terms.dictionary_encode()
        texts: dict = {}
        numbers = coded.indices.to_numpy()
        for doc_id, own in zip(batch.column(0).to_pylist(), np.split(numbers, np.cumsum(count)[:-1])):
            texts.setdefault(doc_id, []).append(own)
        each = [np.unique(np.concatenate(x)) for x in texts.values()]
        yield {"terms": coded.dictionary, "ids": list(texts), "begins": np.append(0, np.cumsum([len(x) for x in each])), "numbers": np.concatenate(each).astype(np.int64)}


def best(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0 in order: equal ones by id, those without id last. Cut after all ties of the k-th are seen."""
    least = 1
    if len(scores) > k:
        least = max(1, int(scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]))
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], no_id[some], -scores[some]))][:k]


def shards(batches):
    """The rows of the index, decoded."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch.column(batch.schema.get_field_index(name))[i]
            yield cell


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: each query's k best documents of the index at `path`."""
    counts = spark.read.parquet(f"{path}/counts").first()
    shared = [spark.sparkContext.broadcast(block) for block in query_blocks(queries, id_col, text_col)]
    index = spark.read.schema(INDEX).parquet(f"{path}/shards")

    def frequencies(batches):
        sums = None
        for cell in shards(batches):
            terms, df = cell("terms").values, np.diff(np.frombuffer(cell("begins").as_buffer(), "<i8"))
            blocks = [unkept(b)["terms"] for b in shared]
            sums = sums or [np.zeros(len(b), np.int64) for b in blocks]
            for own, block in zip(sums, blocks):
                place = pc.index_in(block, value_set=terms)
                some = place.is_valid().to_numpy(zero_copy_only=False)
                own[some] += df[place.drop_null().to_numpy()]
        for number, own in enumerate(sums or ()):
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number, np.int32)), pa.array(some), pa.array(own[some])], names=["block", "term", "df"])

    summed = index.select("terms", "begins").mapInArrow(frequencies, "block int, term long, df long").groupBy("block", "term").agg(F.sum("df").alias("df"))
    weights = [np.zeros(len(b.value["terms"]), np.int64) for b in shared]
    for r in summed.toLocalIterator():  # a row for each distinct term of the queries
        weights[r["block"]][r["term"]] = weight(counts["documents"], r["df"])
    heavy = [spark.sparkContext.broadcast(w) for w in weights]

    def scored(batches):
        kept: dict = {}
        salt = TaskContext.get().partitionId() % SALTS
        for cell in shards(batches):
            n = cell("n_docs").as_py()
            ids = np.frombuffer(cell("ids").as_buffer(), np.int64)
            no_id = np.unpackbits(np.frombuffer(cell("no_id").as_buffer(), np.uint8))[:n].astype(bool)
            terms, begins = cell("terms").values, np.frombuffer(cell("begins").as_buffer(), "<i8")
            docs, impacts = np.frombuffer(cell("docs").as_buffer(), "<i4"), np.frombuffer(cell("impacts").as_buffer(), "<i4")
            for number, (block_, weight_) in enumerate(zip(shared, heavy)):
                block, w = (block_.value, weight_.value) if len(shared) == 1 else (unkept(block_), unkept(weight_))
                place = pc.index_in(block["terms"], value_set=terms).fill_null(-1).to_numpy()
                for q in range(len(block["ids"])):
                    sums = np.zeros(n, np.int64)
                    for t in block["numbers"][block["begins"][q] : block["begins"][q + 1]]:
                        if (p := place[t]) >= 0:
                            a, b = begins[p], begins[p + 1]
                            sums[docs[a:b]] += w[t] * impacts[a:b]
                    top = best(sums, no_id, ids, k)
                    if len(top):
                        new = [sums[top], no_id[top], ids[top]]
                        if (old := kept.get((number, q))) is not None:
                            new = [np.concatenate(x) for x in zip(old, new)]
                            cut = best(*new, k)
                            new = [x[cut] for x in new]
                        kept[number, q] = new
        for number, block_ in enumerate(shared):
            own = [(q, kept[number, q]) for q in range(len(block_.value["ids"])) if (number, q) in kept]
            for i in range(0, len(own), 1000):
                part = own[i : i + 1000]
                ids = [pa.array(x[2], mask=x[1]) for _, x in part]
                item = [block_.value["ids"][q] for q, x in part for _ in x[0]]
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.concat_arrays(ids), pa.array(np.concatenate([x[0] for _, x in part])), pa.array([salt] * len(item), pa.int32())], names=["item_id", "doc_id", "score", "salt"])

    if not shared:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = index.mapInArrow(scored, "item_id long, doc_id long, score long, salt int")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_index(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tables/search-{uuid.uuid4().hex}")
    return search(spark, path, table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT count(*) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d WHERE len(ws) > 0
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, n_all
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), c GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
