"""A full-text index that is kept: changes write segments, searches read all of them, compaction merges them.

Below the index's folder each segment has `postings` (blocks of about BLOCK documents of one term,
with the greatest frequency and the least length in each field), `docs` (the documents that the change
wrote or deleted, with their lengths, terms and frequencies), `terms` (how a term's document count
changed) and `stats` (how the numbers of documents and words changed). A segment counts once its commit is written
after it, so an unfinished write is none; a commit may replace all segments before it, which compaction
does. A document's newest segment holds it: postings of a segment are dead where a later one has the
document, and a deleted one has no postings. Counts of terms are exact without reading dead postings,
as each change takes back what the versions before had counted.

Documents are dealt by hash to parts of about FILE_POSTINGS postings, a file each, sorted by term, with
blocks of the part's documents; so postings are never shuffled one by one: documents are, with their words
counted. A search reads its terms' ranges of each file alone, and a term of every document lies in all files.
Files of terms are parts by hash, sorted too. Null fields have no words and no length; null keys are left
out; of repeated keys in one change the row of the greatest fields counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators.retrieval import K1, B

#: Fields and what a hit in them weighs.
WEIGHTS = {"title": 3.0, "tags": 2.0, "content": 1.0}
#: Documents of a block, and postings of a file.
BLOCK, FILE_POSTINGS = 128, 1_000_000


def _commits(spark: SparkSession, path: str) -> list:
    """The commits in order: number, fields, whether it replaces all before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return sorted(spark.read.schema("segment long, fields array<string>, whole boolean").json(f"{path}/commits").collect(), key=lambda r: r["segment"])


def segments(spark: SparkSession, path: str) -> tuple[list[int], list[str]]:
    """The live segments, the oldest first, and the fields of the index."""
    commits = _commits(spark, path)
    first = max((i for i, r in enumerate(commits) if r["whole"]), default=0)
    return [r["segment"] for r in commits[first:]], commits[-1]["fields"] if commits else []


def _table(spark: SparkSession, path: str, name: str, live: list[int]) -> DataFrame:
    """A table of the live segments, with the column `segment`."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/segment={n}" for n in live])


def _commit(spark: SparkSession, path: str, number: int, fields: list[str], whole: bool) -> None:
    spark.createDataFrame([(number, fields, whole)], "segment long, fields array<string>, whole boolean").coalesce(1).write.mode("append").json(f"{path}/commits")


def _write(spark: SparkSession, path: str, name: str, number: int, rows: DataFrame) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/segment={number}")


def _counted(words: Column, fields: list[str]) -> Column:
    """(terms, tf): the distinct words of all fields in order, and of each field how often it has each of them.

    Runs of equal words in a sorted list, within the row: nothing is shuffled, and long texts cost no more than the sort.
    """
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  so that it is computed once, not for each element
    each = F.flatten(F.transform(words, lambda w, i: F.transform(F.coalesce(w, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), i.alias("i")))))

    def runs(s):
        first = lambda k: (k == 0) | (F.get(s, k)["term"] != F.get(s, k - 1)["term"])
        return bound(F.filter(F.transform(s, lambda x, k: k), first), lambda starts: told(s, starts))

    def told(s, starts):
        slices = F.transform(starts, lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - at))
        times = lambda found, i: F.transform(found, lambda run: F.size(F.filter(run, lambda x: x["i"] == i)))
        tf = lambda found: F.array(*[times(found, i) for i in range(len(fields))])
        return F.struct(F.transform(starts, lambda at: F.get(s, at)["term"]).alias("terms"), bound(slices, tf).alias("tf"))

    return bound(F.sort_array(each), runs)


def _each(fields: list[str]) -> Column:
    """(term, t0, t1, ...) for each term of a document; a row holds its own frequencies, not the document's."""
    return F.explode(F.arrays_zip(F.col("terms").alias("term"), *[F.element_at("tf", i + 1).alias(f"t{i}") for i in range(len(fields))]))


def _blocks(docs: DataFrame, fields: list[str], parts: int) -> DataFrame:
    """The blocks of documents (key, len, terms, tf) in `parts` parts: documents are shuffled once, with their words together, and a part's postings are sorted within its task, as arrays."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size, width, none = BLOCK, len(fields), np.iinfo(np.int32).max

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, keys, lens, terms, tf = (c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns)
        count = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        of, start = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
        if not len(of):
            return
        at = width * start[of] + np.arange(len(of)) - start[of]  # frequencies lie by document, field and term
        flat = tf.flatten().flatten().to_numpy()
        times = np.stack([flat[at + i * count[of]] for i in range(width)], axis=1)
        names = terms.flatten().dictionary_encode()
        sorted_names = pc.sort_indices(names.dictionary).to_numpy()
        rank = np.empty(len(sorted_names), np.int64)
        rank[sorted_names] = np.arange(len(rank))
        rank, part = rank[names.indices.to_numpy()], part.to_numpy().astype(np.int64)[of]
        order = np.lexsort((of, part, rank))
        of, times, rank, part = of[order], times[order], rank[order], part[order]
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (part[1:] != part[:-1])])
        place = np.arange(len(of)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.flatnonzero(place % size == 0)
        bounds = np.append(first, len(of))
        long = lens.flatten().fill_null(0).to_numpy().reshape(-1, width)[of]
        most = np.maximum.reduceat(times, first, axis=0).ravel()
        least = np.minimum.reduceat(np.where(times > 0, long, none), first, axis=0).ravel()
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width), pa.int32()), values)
        for lo in range(0, len(first), 4096):  # blocks of a batch
            some = slice(lo, min(lo + 4096, len(first)))
            begin, end, ends = bounds[lo], bounds[some.stop], slice(some.start * width, some.stop * width)
            mine = pa.array(of[begin:end])
            each = pa.StructArray.from_arrays([keys.take(mine), lists(pa.array(times[begin:end].ravel(), pa.int32())), lens.take(mine)], names=["key", "tf", "len"])
            columns = [
                names.dictionary.take(pa.array(sorted_names[rank[first[some]]])),
                pa.array(part[first[some]] << 32 | place[first[some]] // size),
                pa.array(np.diff(bounds[lo : some.stop + 1])),
                lists(pa.array(most[ends], pa.int32())),
                lists(pa.array(least[ends], pa.int32(), mask=least[ends] == none)),
                pa.ListArray.from_arrays(pa.array(bounds[lo : some.stop + 1] - begin, pa.int32()), each),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "most", "least", "docs"])

    dealt = docs.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "len", "terms", "tf").repartitionById(parts, "part")
    kind = dict(docs.dtypes)["key"]
    return dealt.mapInArrow(run, f"term string, block long, n long, most array<int>, least array<int>, docs array<struct<key: {kind}, tf: array<int>, len: array<int>>>")


def _write_postings(spark: SparkSession, path: str, number: int, fields: list[str]) -> None:
    """Writes the postings of a segment from its documents."""
    docs = spark.read.parquet(f"{path}/docs/segment={number}").where("alive")
    n = docs.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-n // FILE_POSTINGS), min(spark.sparkContext.defaultParallelism, n // 50_000))
    _write(spark, path, "postings", number, _blocks(docs, fields, parts).sortWithinPartitions("term", "block"))


def _newest(spark: SparkSession, path: str, live: list[int]) -> DataFrame | None:
    """(key, newest): the last segment of each document that a later one than the first has; the first holds most documents and is not read."""
    if len(live) < 2:
        return None
    return _table(spark, path, "docs", live[1:]).groupBy("key").agg(F.max("segment").alias("newest"))


def _alive(rows: DataFrame, newest: DataFrame | None) -> DataFrame:
    """Rows (key, segment, ...) that no later segment replaces."""
    if newest is None:
        return rows
    return rows.join(newest, "key", "left").where(F.col("newest").isNull() | (F.col("newest") == F.col("segment"))).drop("newest")


def apply(spark: SparkSession, path: str, changes: DataFrame, key: str = "path", fields: list[str] | None = None) -> int:
    """Writes documents (key, fields) as a new segment and returns its number; rows with a true column `deleted` take theirs out."""
    live, known = segments(spark, path)
    fields = known or fields or list(WEIGHTS)
    commits = _commits(spark, path)
    number = commits[-1]["segment"] + 1 if commits else 1
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    text = lambda f: F.array_join(f, " ") if dict(changes.dtypes)[f].startswith("array") else F.col(f).cast("string")
    rows = changes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), gone.alias("gone"), *[F.when(~gone, text(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    once = rows.groupBy("key").agg(F.max(F.struct(~F.col("gone"), *[f"f{i}" for i in range(len(fields))])).alias("r")).select("key", F.col("r.col1").alias("alive"), *[F.col(f"r.f{i}") for i in range(len(fields))])
    words = [F.when(F.col("alive"), T.tokens(F.col(f"f{i}"), 1)) for i in range(len(fields))]
    cut = once.select("key", "alive", F.array(*words).alias("words")).withColumn("len", F.transform("words", lambda w: F.size(w)))
    _write(spark, path, "docs", number, cut.select("key", "alive", "len", _counted(F.col("words"), fields).alias("c")).select("key", "alive", "len", "c.*"))
    docs = spark.read.parquet(f"{path}/docs/segment={number}")
    before = docs.select("key", F.lit(1).alias("sign"), "len", "terms", "tf", "alive")
    if live:  # the versions that these documents had
        old = _alive(_table(spark, path, "docs", live).join(docs.select("key"), "key", "left_semi"), _newest(spark, path, live))
        before = before.unionByName(old.select("key", F.lit(-1).alias("sign"), "len", "terms", "tf", "alive"))
    before = before.where("alive")
    has = lambda i: F.sum(F.when(F.col(f"e.t{i}") > 0, F.col("sign"))).alias(f"df{i}")
    delta = before.select("sign", _each(fields).alias("e")).groupBy("e.term").agg(*[has(i) for i in range(len(fields))])
    fielded = delta.select("term", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"df{i}").alias("df")) for i in range(len(fields))])).alias("e")).select("term", "e.*")
    _write(spark, path, "terms", number, fielded.where("df <> 0").sortWithinPartitions("term", "field"))
    at = lambda i: F.element_at("len", i + 1)
    sums = [F.array(*[F.coalesce(F.sum(F.col("sign") * value(i)), F.lit(0)).cast("long") for i in range(len(fields))]) for value in (lambda i: at(i).isNotNull().cast("int"), lambda i: F.coalesce(at(i), F.lit(0)))]
    total = before.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), sums[0].alias("with_field"), sums[1].alias("words"))
    _write(spark, path, "stats", number, total.coalesce(1))
    _write_postings(spark, path, number, fields)
    _commit(spark, path, number, fields, False)
    return number


def compact(spark: SparkSession, path: str) -> int | None:
    """Merges all live segments into one and returns its number; searches give what they gave before."""
    live, fields = segments(spark, path)
    if len(live) < 2:
        return None
    number, newest = _commits(spark, path)[-1]["segment"] + 1, _newest(spark, path, live)
    docs = _alive(_table(spark, path, "docs", live), newest).where("alive").drop("segment")
    _write(spark, path, "docs", number, docs)
    _write_postings(spark, path, number, fields)
    terms = _table(spark, path, "terms", live).groupBy("term", "field").agg(F.sum("df").alias("df")).where("df <> 0")
    _write(spark, path, "terms", number, terms.sortWithinPartitions("term", "field"))
    _write(spark, path, "stats", number, _stats_frame(spark, path, live, fields).coalesce(1))
    _commit(spark, path, number, fields, True)
    return number


def _stats_frame(spark: SparkSession, path: str, live: list[int], fields: list[str]) -> DataFrame:
    added = lambda c: F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(len(fields))])
    return _table(spark, path, "stats", live).agg(F.sum("n").alias("n"), added("with_field").alias("with_field"), added("words").alias("words"))


def sync(spark: SparkSession, path: str, notes: DataFrame, key: str = "path", fields: list[str] | None = None) -> int | None:
    """Brings the index in step with the notes (key, fields): only texts that are new or have other words are written, and what is gone is deleted.

    Versions are told apart by a hash of the fields, kept beside the index; None if nothing changed.
    """
    live, known = segments(spark, path)
    fields = known or fields or list(WEIGHTS)
    now = notes.withColumn("_hash", F.sha2(F.to_json(F.struct(*fields)), 256))
    if live:
        kept = _table(spark, path, "hashes", live)
        kept = kept.groupBy("key").agg(F.max_by("hash", "segment").alias("old")).where("old IS NOT NULL")
        both = now.join(kept, F.col("key") == F.col(key), "full_outer")
        changed = both.where("_hash IS NULL OR old IS NULL OR _hash <> old").select(F.coalesce(F.col(key), "key").alias(key), *fields, "_hash", F.col("_hash").isNull().alias("deleted"))
    else:
        changed = now.select(key, *fields, "_hash", F.lit(False).alias("deleted"))
    if changed.isEmpty():
        return None
    commits = _commits(spark, path)
    number = commits[-1]["segment"] + 1 if commits else 1
    _write(spark, path, "hashes", number, changed.select(F.col(key).alias("key"), F.col("_hash").alias("hash")))
    return apply(spark, path, changed, key, fields)


class _Scoring:
    """Numbers that scores depend on: documents, mean lengths, and weights of fields."""

    def __init__(self, spark: SparkSession, path: str, live: list[int], fields: list[str], weights: dict[str, float]):
        row = _stats_frame(spark, path, live, fields).first()
        self.n, self.fields = row["n"] or 0, fields
        self.means = [(row["words"][i] or 0) / row["with_field"][i] if row["with_field"][i] else 0.0 for i in range(len(fields))]
        self.weights = [float(weights.get(f, 0.0)) for f in fields]

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))

    def part(self, i: int, tf: Column, length: Column, df: Column) -> Column:
        """What a term of this frequency in a field adds to a score; 0 without it."""
        mean = self.means[i] or 1.0
        return F.when((tf > 0) & (df > 0), self.weights[i] * self.idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).otherwise(0.0)

    def all(self, tf, length, df) -> Column:
        out = F.lit(0.0)
        for i in range(len(self.fields)):
            out = out + self.part(i, tf(i), length(i), df(i))
        return out


def _hits(spark: SparkSession, path: str, live: list[int], wanted: Column) -> DataFrame:
    """Live postings (term, key, tf, len) of the blocks that are wanted."""
    rows = _table(spark, path, "postings", live).where(wanted).select("segment", "term", F.explode("docs").alias("d")).select("segment", "term", "d.*")
    return _alive(rows, _newest(spark, path, live)).drop("segment")


def search(spark: SparkSession, path: str, words: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score) of documents with words that begin with those of the search, by BM25 of each field; one read of the ranges of these words.

    A word of the search counts as one term: its frequency is that of all words that begin so.
    """
    live, fields = segments(spark, path)
    words = sorted(set(words))
    if not live or not words:
        return spark.createDataFrame([], "key string, score double")
    scoring = _Scoring(spark, path, live, fields, weights or WEIGHTS)
    wanted = F.lit(False)
    for w in words:
        wanted = wanted | F.col("term").startswith(w)
    rows = _hits(spark, path, live, wanted).withColumn("w", F.explode(F.array_compact(F.array(*[F.when(F.col("term").startswith(w), F.lit(k)) for k, w in enumerate(words)]))))
    tf = [F.sum(F.element_at("tf", i + 1)).alias(f"tf{i}") for i in range(len(fields))]
    each = rows.groupBy("key", "len", "w").agg(*tf)
    df = each.groupBy("w").agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(fields))])  # a row for each word
    score = scoring.all(lambda i: F.col(f"tf{i}"), lambda i: F.element_at("len", i + 1), lambda i: F.col(f"df{i}"))
    return each.join(F.broadcast(df), "w").groupBy("key").agg(F.sum(score).alias("score")).where("score > 0")


def top(spark: SparkSession, path: str, words: list[str], k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score): the k best documents for these very words, ties by key, without scoring blocks that can't reach the k-th.

    The blocks of the greatest bounds give a score that k documents reach. Of the others, only those are
    read whose bound, with the greatest bounds of the other words, comes up to it: a document that does
    has all its blocks among them.
    """
    live, fields = segments(spark, path)
    words = sorted(set(words))
    if not live or not words or k < 1:
        return spark.createDataFrame([], "key string, score double")
    scoring = _Scoring(spark, path, live, fields, weights or WEIGHTS)
    wanted = F.col("term").isin(words)
    counts = _table(spark, path, "terms", live).where(wanted).groupBy("term", "field").agg(F.sum("df").alias("df")).collect()  # a row for each word and field
    df_of = {(r["term"], r["field"]): r["df"] for r in counts}
    df = lambda i: F.coalesce(F.create_map(*[F.lit(x) for w in words for x in (w, float(df_of.get((w, i), 0)))])[F.col("term")], F.lit(0.0))
    bound = scoring.all(lambda i: F.element_at("most", i + 1), lambda i: F.element_at("least", i + 1), df)
    blocks = _table(spark, path, "postings", live).where(wanted).select("term", "segment", "block", "n", bound.alias("bound"))
    most = {r["term"]: r["bound"] for r in blocks.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
    score = scoring.all(lambda i: F.element_at("tf", i + 1), lambda i: F.element_at("len", i + 1), df)

    def scored(which: Column) -> DataFrame:
        return _hits(spark, path, live, which).groupBy("key").agg(F.sum(score).alias("score"))

    first = blocks.orderBy(F.desc("bound"), "term", "segment", "block").limit(2 + 2 * -(-k // BLOCK)).collect()
    some = F.lit(False)
    for r in first:
        some = some | ((F.col("term") == r["term"]) & (F.col("segment") == r["segment"]) & (F.col("block") == r["block"]))
    reached = scored(wanted & some).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = reached["least"] if reached["n"] == k else 0.0
    others = F.create_map(*[F.lit(x) for w in words for x in (w, float(sum(v for t, v in most.items() if t != w)))])[F.col("term")]
    return scored(wanted & (bound + others >= least - 1e-9)).where("score > 0").orderBy(F.desc("score"), "key").limit(k)
