"""Filters, joins, set operations and listings of the note and symbol tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators.graph import cut


def search_filter(
    notes: DataFrame,
    collections: list[str] | None = None,
    prefixes: list[str] | None = None,
    tags: list[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    equal: dict[str, str] | None = None,
    least_heat: float | None = None,
    include_archived: bool = False,
) -> DataFrame:
    """The conjunction of the given conditions; undated notes go where a date bound is given."""
    keep = F.lit(True)
    if "archived" in notes.columns and not include_archived:
        keep = keep & ~F.coalesce(F.col("archived"), F.lit(False))
    if collections:
        keep = keep & F.col("collection").isin(collections)
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("path").startswith(p)
        keep = keep & hit
    if tags:
        keep = keep & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if since is not None:
        keep = keep & (F.substring("date", 1, 10) >= since)
    if until is not None:
        keep = keep & (F.substring("date", 1, 10) <= until)
    for name, value in (equal or {}).items():
        keep = keep & (F.col(name) == value)
    if least_heat is not None:
        keep = keep & (F.col("heat") >= least_heat)
    return notes.where(keep)


def allowlist(paths: DataFrame, denied: list[str], globs: list[str]) -> DataFrame:
    """Drops paths with a denied segment; where globs are given, keeps only those that match one."""
    keep = ~F.exists(F.split("path", "/"), lambda s: s.isin(denied)) if denied else F.lit(True)
    if globs:
        hit = F.lit(False)
        for g in globs:
            hit = hit | F.col("path").rlike(T.glob_pattern(g))
        keep = keep & hit
    return paths.where(keep)


def first_match(value: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern matches."""
    out = None
    for pattern, name in rules:
        hit = value.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page, with `has_more`: one row more is looked for, and only the first offset + limit + 1 are ranked."""
    top = rows.orderBy(*order).limit(offset + limit + 1)
    place = F.row_number().over(Window.orderBy(*order))
    last = top.withColumn("place", place)
    more = last.agg(F.max("place").alias("n"))
    return last.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).crossJoin(F.broadcast(more)).withColumn("has_more", F.col("n") > offset + limit).drop("n")


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links (src, target) with the note's path: the exact path with .md, else the first path of that basename, else null."""
    exact = notes.select(F.col("path").alias("exact_path"), F.col("path").alias("key"))
    base = notes.groupBy(F.regexp_replace(T.basename(F.col("path")), r"\.md$", "").alias("base")).agg(F.min("path").alias("base_path"))
    normal = F.regexp_replace(F.regexp_replace("target", r"\\", "/"), r"^/+|/+$", "")
    keyed = links.withColumn("key", F.when(normal.endswith(".md"), normal).otherwise(F.concat(normal, F.lit(".md")))).withColumn("base", F.regexp_replace(T.basename(normal), r"\.md$", ""))
    found = keyed.join(exact, "key", "left").join(base, "base", "left")
    return found.select(*links.columns, F.coalesce("exact_path", "base_path").alias("resolved"))


def unmatched(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Rows that nothing refers to."""
    return rows.join(references.select(key).distinct(), key, "left_anti")


def unique_resolution(calls: DataFrame, symbols: DataFrame, on: list[str], target: str) -> DataFrame:
    """calls with the target of the one symbol that matches; null if none or several do."""
    one = symbols.groupBy(*on).agg(F.count("*").alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")
    return calls.join(one, on, "left")


def longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame, name: str) -> DataFrame:
    """rows with the longest of the prefixes that their value begins with.

    An equi-join on each length that occurs among the prefixes, instead of comparing all pairs.
    """
    lengths = F.broadcast(prefixes.select(F.length(name).alias("n")).distinct().agg(F.collect_list("n").alias("lengths")))
    probes = rows.crossJoin(lengths).withColumn("probe", F.explode_outer(F.filter(F.transform("lengths", lambda n: F.when(F.length(F.col(value)) >= n, F.substring(F.col(value), F.lit(1), n))), lambda p: p.isNotNull())))
    hits = probes.join(prefixes.select(F.col(name).alias("probe"), F.col(name)), "probe", "left")
    keys = [c for c in rows.columns]
    return hits.groupBy(*keys).agg(F.max_by(name, F.length(name)).alias(name))


#: Keys of a group that meet in one tile; larger groups are dealt over several.
TILE_KEYS = 256


def shared_item_pairs(rows: DataFrame, key: str, item: str, least: int, most_in_item: int | None = None) -> DataFrame:
    """(a, b, shared): pairs of keys with `least` items in common; where `most_in_item` is given, items of more keys are left out.

    Keys that share two items meet under each pair of these, so keys that share one meet nowhere. Where
    keys have so many items that their pairs are more than the items' pairs of keys, or one item is
    enough, keys meet under items.
    """
    distinct = rows.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    held = distinct.groupBy(item).agg(F.count("*").alias("n"))
    rare = held.where(F.col("n") > 1 if most_in_item is None else F.col("n").between(2, most_in_item))
    kept = distinct.join(rare, item)
    if least >= 2:
        kept = cut(kept)
        pairs_of = lambda c: kept.groupBy(c).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0.0
        if pairs_of(key) <= pairs_of(item):
            return _by_item_pairs(kept, key, item, least)
    pairs = _pairs_within(kept.select(item, F.col(key).alias("key"), "n"), [item])
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def _pairs_within(rows: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): the pairs a < b of keys of each group, from rows (by, key, n: the group's size).

    A group of many keys is dealt in blocks by hash; each two blocks meet in a tile of their own, so
    that no task holds a whole group, nor makes all its pairs.
    """
    blocks = F.ceil(F.col("n") / TILE_KEYS).cast("int")
    dealt = rows.select(*by, "key", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiles = dealt.groupBy(*by, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct("key", "own")).alias("keys"))
    one = tiles.select((F.col("lo") == F.col("hi")).alias("same"), "keys", F.explode("keys").alias("x"))
    return one.select("same", "x", F.explode("keys").alias("y")).where((F.col("x.key") < F.col("y.key")) & (F.col("same") | (F.col("x.own") != F.col("y.own")))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def _by_item_pairs(kept: DataFrame, key: str, item: str, least: int) -> DataFrame:
    """shared_item_pairs by pairs of items: keys with s items in common meet under s (s - 1) / 2 of them."""
    a, b = kept.alias("a"), kept.alias("b")
    each = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    each = each.select(F.col(f"a.{item}").alias("i"), F.col(f"b.{item}").alias("j"), F.col(f"a.{key}").alias("key"))
    met = each.withColumn("n", F.count("*").over(Window.partitionBy("i", "j"))).where("n > 1")  # most pairs of items are one key's alone
    return _pairs_within(met, ["i", "j"]).groupBy("a", "b").agg(F.round((1 + F.sqrt(1 + 8 * F.count("*"))) / 2).cast("long").alias("shared")).where(F.col("shared") >= least)


def drifted(references: DataFrame, current: DataFrame, key: str, kept: str, now: str) -> DataFrame:
    """References whose target is gone or has another hash."""
    found = references.join(current.select(key, now), key, "left")
    return found.withColumn("state", F.when(F.col(now).isNull(), "missing").when(F.col(kept) != F.col(now), "changed").otherwise("same"))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Parents with their children as a sorted array of structs; children of one parent are few by their nature."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    return parents.join(grouped, key, "left")


def tag_normal(tag: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(tag.cast("string"), "^#+", "")))


def merged_tags(tags: Column, aliases: dict[str, str]) -> Column:
    """Tags with aliases replaced, each once; order and spelling of the others stay. Without aliases they are only made distinct."""
    if not aliases:
        return F.array_distinct(tags)
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.create_map(*pairs)[tag_normal(t)], t)))


def sync_plan(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, action): added, removed, changed or same, from two snapshots with hashes; one full outer join."""
    a, b = old.select(key, F.col(hash_).alias("before")), new.select(key, F.col(hash_).alias("after"))
    action = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key; a change marked `deleted` removes it."""
    both = table.withColumn("deleted", F.lit(False)).unionByName(changes)
    latest = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), version).alias("row"))
    return latest.select(key, "row.*").where(~F.col("deleted")).drop("deleted")
