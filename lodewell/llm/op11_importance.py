"""Importance resampling towards a target distribution, by hashed n-grams of words.

In every task DuckDB lower-cased texts unnests into words, windows into n-grams and counts by
bucket, which is the zlib CRC-32 of the n-gram, a function registered with it; texts are handed over
in chunks of CHUNK bytes, a longer text in pieces that share the words its n-grams run over, so that
memory has a bound. The counts of each document are spilled to Parquet. Spark adds them up over the
documents and over the target, gives each bucket its gain, scores the documents from what was spilled,
and draws the best by Gumbel noise that depends on the document's id alone.

Null and empty texts have no feature and the weight 0. Documents without id have the noise of the id
"" and come last among ties; repeated rows are scored and drawn each, and what is equal in all that is
returned is interchangeable. Ties are ordered by id, then by the number of features. An empty table
gives no rows, an empty target has no counts. Columns other than id and text play no part. Ranks are
places in ranges of scores plus the sizes of the ranges before, so no task sorts all documents.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import LOWER, byte_view, chunks, keyed_texts, lookup, table, word_spans, written

BUCKETS, LONGEST = 10_000, 2
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text that DuckDB holds at a time, rows of them, and rows of scores that a range holds.
CHUNK, CHUNK_ROWS, RANGE_ROWS = 2 << 20, 4096, 500_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = lookup(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)


def statement(buckets: int, longest: int) -> str:
    """Bucket counts of each row r of `texts`; n-grams that begin in the last `extra` words are another row's."""
    sizes = range(1, longest + 1)
    ahead = "".join(f", lead(word, {j}) OVER follow AS w{j}" for j in sizes[:-1])
    features = " UNION ALL ".join(
        f"SELECT r, {size} AS size, {" || ' ' || ".join(['word', *(f'w{j}' for j in range(1, size))])} AS feature FROM grams WHERE i < own" + (f" AND w{size - 1} IS NOT NULL" if size > 1 else "") for size in sizes
    )
    return f"""
WITH listed AS (SELECT r, extra, regexp_extract_all(text, '{WORD}') AS ws FROM texts),
     words AS (SELECT r, len(ws) - extra AS own, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM listed),
     grams AS (SELECT r, own, i, word{ahead} FROM words WINDOW follow AS (PARTITION BY r ORDER BY i)),
     features AS ({features}),
     counted AS (SELECT r, CAST(zlib_crc32(feature) % {buckets} AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n, count(*) FILTER (size = 1) AS ones FROM features GROUP BY ALL)
SELECT r, list(bucket) AS buckets, list(n) AS counts, CAST(sum(ones) AS BIGINT) AS n_words, CAST(sum(n) AS BIGINT) AS n_features FROM counted GROUP BY r"""


def crc32s(features: pa.Array) -> pa.Array:
    """zlib's CRC-32 of each string's UTF-8 bytes."""
    column = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    return pa.array(list(map(zlib.crc32, column.cast(pa.binary()).to_pylist())), pa.uint32())


class Counter:
    """Bucket counts of texts by a DuckDB connection in memory, of one thread."""

    def __init__(self, buckets: int, longest: int):
        import duckdb

        self.buckets, self.longest, self.sql = buckets, longest, statement(buckets, longest)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.create_function("zlib_crc32", crc32s, ["VARCHAR"], "UINTEGER", type="arrow")

    def counted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, extra: np.ndarray) -> pa.Table:
        """The statement's rows for stretches of lower-cased bytes."""
        if len(starts) and (starts[1:] == ends[:-1]).all():
            offsets = np.append(starts, ends[-1:]) - starts[0]
            data = data[starts[0] : ends[-1]]
        else:
            offsets = np.append(0, np.cumsum(ends - starts))
            data = np.concatenate([data[a:b] for a, b in zip(starts, ends)] or [data[:0]])
        texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        self.db.register("texts", pa.table({"r": pa.array(np.arange(len(starts))), "extra": pa.array(extra), "text": texts}))
        try:
            return self.db.sql(self.sql).to_arrow_table()
        finally:
            self.db.unregister("texts")

    def pieces(self, low: np.ndarray):
        """The counts of one long text, piece by piece; a piece ends with the first words of the next one."""
        starts, ends, _ = word_spans(_WORD[low], np.array([0, len(low)]))
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(low), CHUNK)), len(starts)))
        for a, b in zip(cuts, cuts[1:]):
            reach = min(b + self.longest - 1, len(starts))
            yield self.counted(low, starts[a : a + 1], ends[reach - 1 : reach], np.array([reach - b]))

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        """n_words, n_features, buckets and counts of each text."""
        data, offsets = byte_view(texts)
        low = LOWER[data]
        if len(texts) == 1 and len(low) > 2 * CHUNK:
            sums, words = np.zeros(self.buckets, np.int64), 0
            for piece in self.pieces(low):
                for buckets, counts, n in zip(piece.column("buckets"), piece.column("counts"), piece.column("n_words").to_pylist()):
                    sums[buckets.values.to_numpy()] += counts.values.to_numpy()
                    words += n
            some = np.flatnonzero(sums)
            return [pa.array([words]), pa.array([int(sums.sum())]), pa.array([some.astype(np.int32)]), pa.array([sums[some]], pa.list_(pa.int32()))]
        found = self.counted(low, offsets[:-1], offsets[1:], np.zeros(len(texts), np.int64))
        place = np.full(len(texts), found.num_rows, np.int64)  # texts without words have the row after the last
        place[found.column("r").to_numpy()] = np.arange(found.num_rows)
        out = []
        for name in ("n_words", "n_features", "buckets", "counts"):
            column = pa.concat_arrays([*(c.cast(KINDS[name]) for c in found.column(name).chunks), pa.array([[] if name in ("buckets", "counts") else 0], KINDS[name])])
            out.append(column.take(pa.array(place)))
        return out


KINDS = {"n_words": pa.int64(), "n_features": pa.int64(), "buckets": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}
COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and how often each bucket occurs, spilled to Parquet in the shared folder; texts are read once and not shuffled."""

    def run(batches):
        count = Counter(buckets, longest)
        for batch in batches:
            for rows in chunks(batch, limit=CHUNK, most=CHUNK_ROWS):
                yield pa.RecordBatch.from_arrays([rows.column(0), *count(rows.column(1))], names=["doc_id", *KINDS])

    return written(keyed_texts(docs, id_col, text_col).mapInArrow(run, COUNTS), "bucket-counts")


def totals(counted: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: sums over all documents, added up within each task first."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), weights=batch.column(1).flatten().to_numpy(), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    return counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain, a row for each of the given number of buckets on the driver."""
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(totals(source, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(totals(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    rows = both.select("bucket", "s", "t").collect()
    all_s, all_t = sum(r["s"] for r in rows) + buckets, sum(r["t"] for r in rows) + buckets
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = math.floor(1000.0 * math.log(float(r["t"] + 1) * float(all_s) / (float(r["s"] + 1) * float(all_t))))
    return out


def weighted(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of the gains of a document's features."""

    def run(batches):
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy().astype(np.int64)
            worth = gain[batch.column(3).flatten().to_numpy()] * batch.column(4).flatten().to_numpy()
            sums = np.append(0, np.cumsum(worth))
            total = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total // np.maximum(batch.column(2).to_numpy(), 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down: of the id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Rows with `rank` among those of enough words, 1 for the highest score; null for those that aren't drawn. `scored` must be a written table."""
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_place")]
    sorted_rows = scored.filter(able).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).sortWithinPartitions(*order).drop("_place")
    numbered = written(sorted_rows.withColumn("_id", F.monotonically_increasing_id()).select("*", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id"), "ranks")
    # a row for each range, RANGE_ROWS documents or so
    before = numbered.groupBy("_range").count().select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    rank = F.col("_before") + F.col("_at") + 1
    chosen = numbered.join(F.broadcast(before), "_range").withColumn("rank", F.when(rank <= percent * n // 100, rank)).drop("_range", "_at", "_before")
    return chosen.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, target_id: str = "item_id") -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank; the drawn ones, of the highest scores, have a rank."""
    counted = bucket_counts(docs, buckets, longest)
    gain = gains(counted, bucket_counts(target, buckets, longest, target_id), buckets)
    scored = weighted(counted, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(written(scored, "scores"), percent, least_words)


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs whose id is drawn, with all their columns."""
    chosen = resample(docs, target, **settings).filter("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(chosen.withColumnRenamed("doc_id", "_drawn"), F.col("_drawn").eqNullSafe(docs["doc_id"].cast("long")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the distinct n-grams; its table of 256 remainders follows from the polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS byte, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), remainders AS (
  SELECT list(c ORDER BY byte) AS crc FROM bits WHERE k = 8
), texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), features AS (
  SELECT kind, id, unnest(ws) AS feature FROM words
  UNION ALL
  SELECT kind, id, ws[i] || ' ' || ws[i + 1] FROM (SELECT kind, id, ws, unnest(range(1, len(ws))) AS i FROM words)
), counted AS (
  SELECT kind, id, feature, count(*) AS n FROM features GROUP BY ALL
), crcs AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(feature)), 2), lambda i: CAST('0x' || substr(hex(encode(feature)), i, 2) AS BIGINT))),
                                  lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), remainders
), per_bucket AS (
  SELECT kind, id, bucket, sum(n) AS n FROM counted JOIN crcs USING (feature) GROUP BY ALL
), sums AS (
  SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM per_bucket GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(s) FROM sums), 0) + 10000 AS DOUBLE)
                                     / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(t) FROM sums), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM per_bucket JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n_features), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN weights USING (id) WHERE kind = 0
), noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) <= 25 * (SELECT count(*) FROM noisy WHERE n_words >= 20) // 100
            THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank
FROM noisy
"""
