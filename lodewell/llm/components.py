"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.common import discard, written


#: Edges that one task of a round may well hold.
EDGES_A_TASK = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node of its component.

    Each round joins the edges with the least neighbour of each node; hubs only meet partial
    minima, and their joins are plain sort-merge joins, which Spark can split. Rounds grow with
    the logarithm of the longest path, and go on until nothing changes; each is written to the
    shared folder.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_of == before:
            break
        before = print_of
        tasks = min(parts, 1 + print_of[0] // EDGES_A_TASK)
        few = lambda df: df.coalesce(tasks)  # noqa: B023,E731  small tables don't need every shuffle partition a task
        both = now.union(now.select("b", "a"))
        least = few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        large = written(few(large.distinct()), "large-star")
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a"))
        old = now
        both = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(few(both.distinct()), "small-star")
        discard(old)
        discard(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
