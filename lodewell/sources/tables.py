"""Parquet tables of a directory, and views of them in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that costs far more than reading them: a small table may come as one row group, which a single task would read, so it is dealt over the cores."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < min(cores, 16) else docs


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: path, title (first line), content, tags (lang and source), collection (lang), heat from the id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("collection"),
        (F.col("doc_id") % 17).alias("heat"),
        "n_chars",
    )


#: The same view in SQL, for statements that need it.
NOTES_SQL = """notes AS (
  SELECT doc_id, lang || '/' || source || '/' || doc_id || '.md' AS path, split_part(text, chr(10), 1) AS title, text AS content,
         [lang, source] AS tags, lang AS collection, doc_id % 17 AS heat, n_chars FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
