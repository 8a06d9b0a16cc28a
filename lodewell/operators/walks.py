"""Bounded walks: neighbours of one node by distance, with a cap on nodes, the edges that were looked at, and names that resolve to nothing.

What is seen is bounded by the cap, so each step joins the edges with a small table; no step shuffles
the graph. Within a distance nodes are taken in order of their names until the cap is reached, and
those beyond it are neither returned nor walked from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next, src, dst): each edge in the directions that are walked."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), "src", "dst")
    into = edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), "src", "dst")
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def walk(edges: DataFrame, start, hops: int, limit: int = 50, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (node, hops) within `hops` steps of the start, at most `limit` with the start; distinct edges (src, dst) of those that were walked from.

    Null ends are no nodes. A start without edges is alone; so is one that the edges don't know.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    steps = _steps(edges.where("src IS NOT NULL AND dst IS NOT NULL"), direction)
    schema = f"node {kind}, hops int"
    seen, frontier = [(start, 0)], [start]  # `limit` entries at most
    walked = []
    for hop in range(1, hops + 1):
        if not frontier:
            break
        walked += frontier
        here = F.broadcast(spark.createDataFrame([(n,) for n in frontier], f"at {kind}"))
        left = limit - len(seen)
        known = F.broadcast(spark.createDataFrame([(n,) for n, _ in seen], f"next {kind}"))
        new = steps.join(here, "at").select("next").distinct().join(known, "next", "left_anti").orderBy("next").limit(max(left, 0))
        frontier = [r["next"] for r in new.collect()] if left > 0 else []
        seen += [(n, hop) for n in frontier]
    nodes = spark.createDataFrame(seen[:limit], schema)
    at = F.broadcast(spark.createDataFrame([(n,) for n in walked], f"at {kind}"))
    return nodes, steps.join(at, "at").select("src", "dst").distinct()


def callers(calls: DataFrame, symbol, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """`walk` against calls (caller_id, callee_id): who calls the symbol, and through whom."""
    return walk(_called(calls), symbol, depth, limit, "in")


def callees(calls: DataFrame, symbol, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`walk` along calls (caller_id, callee_id, callee_name), and the names (callee_name, calls) that the symbol itself calls and that resolve to no symbol."""
    nodes, edges = walk(_called(calls), symbol, depth, limit, "out")
    unresolved = calls.where((F.col("caller_id") == symbol) & F.col("callee_id").isNull()).groupBy("callee_name").agg(F.count("*").alias("calls"))
    return nodes, edges, unresolved


def _called(calls: DataFrame) -> DataFrame:
    return calls.where("callee_id IS NOT NULL").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))


def titled(nodes: DataFrame, path: Column) -> DataFrame:
    """Nodes with the title that their path ends in."""
    return nodes.withColumn("title", F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), "^.*/", ""))
