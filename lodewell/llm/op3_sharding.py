"""Sharding by a k-d tree: nodes are cut at weighted medians along their widest metadata dimension.

A node that shall give m leaves is cut where the weight of m // 2 of them lies. Cuts are found on
aggregates alone: the weights of BINS slices of each node's range come to the driver, the slice
that holds the cut is sliced again, and so on. Rows of one value of the dimension are cut by the
hash of their text. So equal texts, whose dimensions are equal too, lie together in every order.
Where a cut falls into a group of equal texts that fits in a shard, the cut moves to the group's
nearer edge; if that is more than SMALL of a shard away, the group goes to the right side as a
whole and the cut is sought again without it, up to ASIDE times. So the shards' bytes stay near
equal. Only a group larger than a shard is cut, by the hash of its ids: it can't lie in one shard.

Null texts have no bytes, like empty ones; null ids are hashed like any. Repeated rows each get a
slot. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import discard, table, written

SHARDS, OVERHEAD = 24, 8
#: Slices of a node's range that one pass weighs, and the share of a shard that a cut may be off.
BINS, TOLERANCE = 2048, 0.001
#: Share of a shard that a cut may move by so as not to split a group, and groups of a node that may be set aside.
SMALL, ASIDE = 0.005, 6
#: Rows that one counting group of a shard holds on average at most.
SLOT_ROWS, LEAST_GROUPS = 20_000, 64

DIMENSIONS = ["size_log", "wide_share", "line_log"]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: id, size, crc32 of the text, the dimensions, and hashes of text and id as doubles."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.log2(size).alias("size_log"),
        ((F.octet_length(text) - F.length(text)) / F.greatest(F.lit(1), F.octet_length(text))).alias("wide_share"),
        F.log2(1 + F.length(text) / lines).alias("line_log"),
        F.xxhash64(text).cast("double").alias("text_hash"),
        F.xxhash64(F.col(id_col).cast("long"), F.lit(7)).cast("double").alias("id_hash"),
    )


def open_nodes(node: dict) -> list[dict]:
    if "cut" in node:
        return open_nodes(node["left"]) + open_nodes(node["right"])
    return [node] if node["leaves"] > 1 and not node.get("done") else []


def sought(nodes: list[dict], columns: list[str]) -> Column:
    """What is sought in the row's node, looked up in a literal map: the key's place among `columns`, its range, what ties come before it, and the groups set aside."""
    entries = []
    for n in nodes:
        ties = [(columns.index(name), value) for name, value in n["at"]] + [(-1, 0.0)] * 2
        numbers = {"key": columns.index(n["keys"][len(n["at"])]), "tie": ties[0][0], "next_tie": ties[1][0]}
        values = {"low": n["low"], "high": n["high"], "value": ties[0][1], "next_value": ties[1][1]}
        fields = [F.lit(v).alias(k) for k, v in numbers.items()] + [F.lit(float(v)).alias(k) for k, v in values.items()]
        entries += [F.lit(n["first"]), F.struct(*fields, F.array(*[F.lit(float(x)) for x in (math.nan, *n["whole"])]).alias("whole"))]
    return F.element_at(F.create_map(*entries), F.col("node"))


def split(rows: DataFrame, nodes: list[dict], columns: list[str]) -> DataFrame:
    """rows with the number of the child that they fall to, for those of the cut nodes: left before the cut in the order of its columns, and not set aside."""
    entries = []
    for n in nodes:
        cut = [(columns.index(name), value) for name, value in n["cut"]] + [(-1, 0.0)] * 2
        numbers = [F.lit(k).alias(f"k{i}") for i, (k, _) in enumerate(cut[:3])] + [F.lit(float(v)).alias(f"v{i}") for i, (_, v) in enumerate(cut[:3])]
        entries += [F.lit(n["first"]), F.struct(*numbers, F.lit(n["leaves"] // 2).alias("shift"), F.array(*[F.lit(float(x)) for x in (math.nan, *n["whole"])]).alias("whole"))]
    held = rows.withColumn("s", F.element_at(F.create_map(*entries), F.col("node"))).withColumn("keys", F.array(*columns))
    key = lambda i: F.get("keys", f"s.k{i}")
    below, same = (lambda i: key(i) < F.col(f"s.v{i}")), (lambda i: (key(i) == F.col(f"s.v{i}")) & (F.col(f"s.k{i + 1}") >= 0))
    left = (below(0) | (same(0) & (below(1) | (same(1) & below(2))))) & ~F.array_contains("s.whole", F.col("text_hash"))
    node = F.when(F.col("s").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("s.shift"))
    return held.withColumn("node", node).drop("s", "keys")


def slices_of(rows: DataFrame, nodes: list[dict], columns: list[str]) -> DataFrame:
    """(node, bin, weight, low, high): the weights of the slices of each node's range, and the range of keys in each."""
    held = rows.where(F.col("node").isin([n["first"] for n in nodes])).select("node", "size", "text_hash", F.array(*columns).alias("keys"), sought(nodes, columns).alias("s"))
    held = held.withColumn("key", F.get("keys", "s.key"))
    tied = ((F.col("s.tie") < 0) | (F.get("keys", "s.tie") == F.col("s.value"))) & ((F.col("s.next_tie") < 0) | (F.get("keys", "s.next_tie") == F.col("s.next_value")))
    held = held.where(F.col("key").between(F.col("s.low"), F.col("s.high")) & tied & ~F.array_contains("s.whole", F.col("text_hash")))
    width = F.greatest(F.col("s.high") - F.col("s.low"), F.lit(1e-300))
    place = F.least(F.lit(BINS - 1), F.floor((F.col("key") - F.col("s.low")) / width * BINS))
    return held.groupBy("node", place.alias("bin")).agg(F.sum("size").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"))


def find_cuts(rows: DataFrame, nodes: list[dict], spreads: dict, total: float, shards: int, dimensions: list[str]) -> None:
    """Gives each node its cut, a list of (column, value), or marks it done if it has no rows."""
    numbers = [n["first"] for n in nodes]
    held = rows.where(F.col("node").isin(numbers))
    ranges = held.groupBy("node").agg(F.sum("size").alias("weight"), *[f(d).alias(f"{k}_{d}") for d in dimensions for k, f in (("low", F.min), ("high", F.max))]).collect()
    by_number, shard = {n["first"]: n for n in nodes}, total / shards
    for n in nodes:
        n["done"] = True
    active = []
    for r in ranges:
        n = by_number[r["node"]]
        widest = max(dimensions, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / spreads[d])
        left = n["leaves"] // 2
        start = {"at": [], "low": r[f"low_{widest}"], "high": r[f"high_{widest}"], "missing": float(r["weight"]) * left / n["leaves"]}
        room = float(r["weight"]) - start["missing"]
        n |= {"done": False, "keys": [widest, "text_hash", "id_hash"], "start": start, "room": room, "whole": []} | start
        n["at"] = []
        active.append(n)
    while active:
        weights: dict = {n["first"]: [] for n in active}
        for r in slices_of(rows, active, [*dimensions, "text_hash", "id_hash"]).collect():
            weights[r["node"]].append(r)
        going = []
        for n in active:
            slices, key = sorted(weights[n["first"]], key=lambda r: r["bin"]), n["keys"][len(n["at"])]
            for k, r in enumerate(slices):
                if r["weight"] >= n["missing"] or k == len(slices) - 1:
                    break
                n["missing"] -= r["weight"]
            last = len(n["at"]) == len(n["keys"]) - 1
            alike = r["low"] == r["high"]
            fits = alike and key == "text_hash" and r["weight"] <= shard
            aside = fits and min(n["missing"], r["weight"] - n["missing"]) > SMALL * shard and r["weight"] <= n["room"] and len(n["whole"]) < ASIDE
            if r["weight"] <= TOLERANCE * shard or (alike and last) or (fits and not aside):
                after = n["missing"] > r["weight"] / 2
                value = math.nextafter(r["high"], math.inf) if after else r["low"]
                n["cut"] = [*n["at"], (key, value)]
            elif aside:
                n["whole"].append(r["low"])  # the group goes right; the cut is sought without it
                n["room"] -= r["weight"]
                n |= n["start"] | {"at": []}
                going.append(n)
            elif alike:
                n["at"].append((key, r["low"]))
                n["low"], n["high"] = -(2.0**63), 2.0**63
                going.append(n)
            else:
                n["low"], n["high"] = r["low"], r["high"]
                going.append(n)
        active = going
    for n in nodes:
        if "cut" in n:
            left = n["leaves"] // 2
            n["left"] = {"first": n["first"], "leaves": left}
            n["right"] = {"first": n["first"] + left, "leaves": n["leaves"] - left}


def grown(rows: DataFrame, shards: int, dimensions: list[str] | None = None) -> tuple[dict, DataFrame]:
    """The tree, as nested dictionaries, and the rows with their leaf as `node`.

    The driver holds a few numbers for each node; after each level the narrow rows are written with
    the nodes that they have come to, so no expression grows with the tree.
    """
    dimensions = dimensions or DIMENSIONS
    whole = rows.agg(F.sum("size").alias("weight"), *[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).first()
    spreads = {d: whole[d] or 1.0 for d in dimensions}
    tree, rows, old = {"first": 0, "leaves": shards}, rows.withColumn("node", F.lit(0)), None
    while nodes := open_nodes(tree):
        find_cuts(rows, nodes, spreads, float(whole["weight"] or 0), shards, dimensions)
        if cut := [n for n in nodes if "cut" in n]:
            rows = written(split(rows, cut, [*dimensions, "text_hash", "id_hash"]), "level")
            if old is not None:
                discard(old)
            old = rows
    return tree, rows


def kd_tree(rows: DataFrame, shards: int, dimensions: list[str] | None = None) -> dict:
    """The tree alone."""
    return grown(rows, shards, dimensions)[0]


def slotted(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Gapless slots from 0 within each shard, counted in many small groups and shifted by the groups before."""
    groups = max(LEAST_GROUPS, -(-count // (shards * SLOT_ROWS)))
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)))
    counts = grouped.groupBy("shard", "group").agg(F.count("*").alias("n"))
    shifts = counts.select("shard", "group", (F.sum("n").over(Window.partitionBy("shard").orderBy("group")) - F.col("n")).alias("shift"))
    place = F.row_number().over(Window.partitionBy("shard", "group").orderBy("doc_id", "text_crc32")) - 1
    return grouped.withColumn("place", place).join(shifts, ["shard", "group"]).withColumn("slot", (F.col("shift") + F.col("place")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot; the texts are read once and not shuffled."""
    rows = written(described(docs, id_col, text_col), "described")
    _, dealt = grown(rows, shards)
    return slotted(dealt.withColumnRenamed("node", "shard"), rows.count(), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
