"""What is written: notes moved and deleted, vectors kept in step with texts, journals, change logs, reports, mirrors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def moved(notes: DataFrame, moves: DataFrame, order: str | None = None) -> DataFrame:
    """notes (path, ...) after moves (path, to); what has been at a target goes, and a path to null is deleted.

    All moves read the notes as they were. Of several moves of one path, and of several to one target,
    the last in the order of the column `order` counts, without it the one of the greatest target and
    path; notes that lose their target to another one are overwritten and go.
    """
    given = [order] if order else []
    last = F.struct(*given, F.col("to").isNotNull().alias("kept"), "to")
    plan = moves.groupBy("path").agg(F.max(last).alias("plan")).select("path", F.col("plan.kept").alias("_kept"), F.col("plan.to").alias("_to"), *[F.col(f"plan.{c}").alias("_order") for c in given])
    there = notes.join(plan, "path", "left")
    by = Window.partitionBy("_to").orderBy(*[F.desc("_order") for _ in given], F.desc("path"))
    leaving = there.where("_kept").withColumn("_place", F.row_number().over(by)).where("_place = 1").withColumn("path", F.col("_to")).select(*notes.columns)
    staying = there.where("_kept IS NULL").select(*notes.columns).join(leaving.select("path"), "path", "left_anti")
    return staying.unionByName(leaving)


def vector_changes(texts: DataFrame, stored: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, hash, action): embed what is new or has another hash than its stored vector (key, hash), drop what is gone, keep the rest."""
    now = texts.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"))
    both = now.join(stored.select(key, F.col("hash").alias("_old")), key, "full_outer")
    action = F.when(F.col("hash").isNull(), "drop").when(F.col("_old").isNull() | (F.col("_old") != F.col("hash")), "embed").otherwise("keep")
    return both.select(key, F.coalesce("hash", "_old").alias("hash"), action.alias("action"))


def synced_vectors(texts: DataFrame, stored: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "path", text: str = "content") -> DataFrame:
    """The vectors (key, hash, embedding) after a sync: only changed texts go through `embed`, which adds a column embedding."""
    plan = vector_changes(texts, stored, key, text)
    fresh = embed(texts.select(key, text).join(plan.where("action = 'embed'").select(key, "hash"), key)).select(key, "hash", "embedding")
    return stored.join(plan.where("action = 'keep'").select(key), key, "left_semi").select(key, "hash", "embedding").unionByName(fresh)


def hashed_vectors(size: int = 64, text: str = "content") -> Callable[[DataFrame], DataFrame]:
    """An embedding without a model: signed counts of words hashed to `size` places, of unit length; a null text has all zeros."""

    def embed(rows: DataFrame) -> DataFrame:
        words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.xxhash64(w))
        at = lambda i: F.aggregate(F.filter("_words", lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0))
        raw = rows.withColumn("_words", words).withColumn("_raw", F.array(*[at(i) for i in range(size)])).drop("_words")
        norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x * x))
        return raw.withColumn("_norm", norm).withColumn("embedding", F.transform("_raw", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0))).drop("_raw", "_norm")

    return embed


def save_vectors(vectors: DataFrame, path: str, version: int) -> None:
    """A version of the vectors, and a note that it is whole, written after it."""
    vectors.write.parquet(f"{path}/vectors/{version:08d}")
    vectors.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(path + "/whole")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the vectors that is whole; an unfinished write is none."""
    newest = spark.read.parquet(path + "/whole").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/vectors/{newest:08d}")


def append_journal(entries: DataFrame, path: str, at: str = "at", text: str = "text") -> None:
    """Timestamped lines, appended to the file tree of their day."""
    line = F.concat(F.lit("- "), F.date_format(at, "HH:mm"), F.lit(" "), F.regexp_replace(text, r"\s+", " "))
    entries.select(F.date_format(at, "yyyy-MM-dd").alias("day"), line.alias("line")).write.mode("append").partitionBy("day").text(path)


#: Bits of an id for a row within its task, and for the task within its batch.
ROW_BITS, TASK_BITS = 26, 14


def append_changes(spark: SparkSession, changes: DataFrame, path: str, batch: int | None = None) -> None:
    """Changes appended to a log under ids that grow from batch to batch (not gapless), for `changes_after` and streams.

    Ids are (batch, task, row) in one number, and a batch written again replaces itself. So writers that
    number their batches, as streams do, may repeat a write without effect, and never give one id twice:
    stream.writeStream.foreachBatch(lambda rows, n: append_changes(spark, rows, path, n)). Without a
    number it is the one after the greatest that is there, which is for a single writer. A batch holds
    2**26 rows a task and 2**14 tasks; more is an error.
    """
    if batch is None:
        there = spark.createDataFrame([], "batch long")
        if _exists(spark, path):
            there = spark.read.parquet(path).select("batch")
        batch = (there.agg(F.max("batch")).first()[0] or 0) + 1
    made = F.monotonically_increasing_id()
    numbered = changes.withColumn("_made", made).withColumn("_task", F.shiftright("_made", 33)).withColumn("_row", F.col("_made").bitwiseAND((1 << 33) - 1))
    fits = (F.col("_task") < 1 << TASK_BITS) & (F.col("_row") < 1 << ROW_BITS)
    number = F.lit(batch << (TASK_BITS + ROW_BITS)).cast("long") + F.shiftleft("_task", ROW_BITS) + F.col("_row")
    rows = numbered.withColumn("id", F.when(fits, number).otherwise(F.raise_error(F.lit("too many rows for one batch of a change log")).cast("long"))).drop("_made", "_task", "_row")
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def changes_after(spark: SparkSession, path: str, watermark: int) -> DataFrame:
    """What was appended after the id, in order of ids."""
    return spark.read.parquet(path).where(F.col("id") > watermark).orderBy("id")


def write_report(summary: DataFrame, details: DataFrame, path: str, at: str) -> None:
    """An evaluation: the last report (summary and details) is overwritten, its headline is appended to the history."""
    summary.withColumn("at", F.lit(at)).write.mode("overwrite").json(path + "/last/summary")
    details.write.mode("overwrite").json(path + "/last/details")
    summary.withColumn("at", F.lit(at)).write.mode("append").json(path + "/history")


def write_state(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """A table of state (metrics, sessions, co-recall, registry, savings) as JSON lines; with `partition`, only parts with rows are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).json(path)


def mirror(repos: DataFrame, key: str = "repo_id", groups: int = 1) -> DataFrame:
    """(part, document): the table as JSON documents of sorted rows; a registry is one document, a larger table has `groups`."""
    part = F.pmod(F.xxhash64(key), F.lit(groups))
    row = F.struct(key, *[c for c in repos.columns if c != key])
    return repos.groupBy(part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("document"))
