"""The registry of entities: names and aliases are one space of keys, and what shares a key is one entity.

A sighting has a name, a type, a tier, aliases, the note that has it, and a day. Sightings are added up
by name first, so a hot name is one row; names and aliases then are edges, whose connected components
are the entities. All that is kept of an entity is a least or greatest value, a sum or a union, so it
matters neither in what order sightings come nor how they are dealt over merges: the name and the type
are those of the earliest sighting (of the least name on one day), the tier is the highest ever given.

Null names and blank ones are no sightings, null and blank aliases none; a null type, tier or day gives
way to others. An empty registry and empty sightings give an empty registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators.graph import components, cut

#: Tiers, the least first.
TIERS = ["suggested", "detected", "confirmed"]
SIGHTING = "name string, type string, tier string, aliases array<string>, note_path string, seen date"


def normal(name: Column) -> Column:
    """How names are compared: in lower case, with single blanks."""
    return F.lower(T.squeezed(name))


def sightings(found: DataFrame, path: str, seen: Column, tier: str = "detected") -> DataFrame:
    """Sightings of detected entities (name, type)."""
    return found.select("name", "type", F.lit(tier).alias("tier"), F.array().cast("array<string>").alias("aliases"), F.col(path).cast("string").alias("note_path"), seen.cast("date").alias("seen"))


def _entries(rows: DataFrame) -> DataFrame:
    """Rows with what the merge adds up: key, rank of the tier, days and occurrences."""
    if "seen" in rows.columns:
        rows = rows.withColumns({"first_seen": F.col("seen"), "last_seen": F.col("seen"), "occurrences": F.lit(1).cast("long")})
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(1)).cast("int")
    return rows.select("name", "type", rank.alias("rank"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "note_path", "first_seen", "last_seen", F.col("occurrences").cast("long").alias("occurrences"), normal(F.col("name")).alias("key")).where("key <> ''")


def _links(named: DataFrame, forms: DataFrame) -> DataFrame:
    """Edges (src, dst) of names alone: those that share an alias, or have one that is a name, are tied to the least of them; an alias of one name ties nothing."""
    owners = forms.select("other", "key").unionByName(named.select(F.col("key").alias("other"), "key"))
    least = owners.groupBy("other").agg(F.min("key").alias("dst"))
    return owners.join(least, "other").where("key <> dst").select(F.col("key").alias("src"), "dst").distinct()


def merged(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The registry (name, type, aliases, first_seen, last_seen, note_path, tier, confirmed, occurrences) after the sightings `new`."""
    rows = _entries(new) if stored is None else cut(_entries(stored)).unionByName(_entries(new))  # what is stored is worked out once, not for each use of the rows
    # dates may be missing: these sightings come last
    first = F.min(F.struct(F.coalesce("first_seen", F.lit("9999-12-31").cast("date")).alias("day"), "name", F.coalesce("type", F.lit("~")).alias("type"))).alias("first")
    added = [first, F.max("last_seen").alias("last_seen"), F.min("first_seen").alias("first_seen"), F.max("rank").alias("rank"), F.min("note_path").alias("note_path"), F.sum("occurrences").alias("occurrences")]
    named = rows.groupBy("key").agg(*added)
    forms = rows.select("key", F.explode("aliases").alias("alias")).select("key", normal(F.col("alias")).alias("other"), "alias").where("other <> ''").groupBy("key", "other").agg(F.min("alias").alias("form"))
    root = components(_links(named, forms)).withColumnRenamed("node", "key")
    placed = lambda t: t.join(root, "key", "left").withColumn("root", F.coalesce("component", "key")).drop("component")
    again = [F.min("first").alias("first"), F.max("last_seen").alias("last_seen"), F.min("first_seen").alias("first_seen"), F.max("rank").alias("rank"), F.min("note_path").alias("note_path"), F.sum("occurrences").alias("occurrences")]
    entities = placed(named).groupBy("root").agg(*again)
    # an alias is of its owner's entity; an entity's names are few by their nature: one form for each key
    own_forms = placed(named.select("key", F.col("key").alias("other"), F.col("first.name").alias("form")).unionByName(forms))
    names = own_forms.groupBy("root", F.col("other").alias("key")).agg(F.min("form").alias("form")).groupBy("root").agg(F.sort_array(F.collect_list(F.struct("key", "form"))).alias("names"))
    both = entities.join(names, "root")
    own = normal(F.col("first.name"))
    return both.select(
        "first.name",
        F.nullif(F.col("first.type"), F.lit("~")).alias("type"),
        F.transform(F.filter("names", lambda n: n["key"] != own), lambda n: n["form"]).alias("aliases"),
        "first_seen",
        "last_seen",
        "note_path",
        F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank")).alias("tier"),
        (F.col("rank") == len(TIERS)).alias("confirmed"),
        "occurrences",
    )


def resolved(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """The rows of names with `entity`, `entity_type` and `tier` of what they name, by name or alias; null where the registry knows none."""
    known = registry.select(F.explode(F.array_union(F.array("name"), "aliases")).alias("_form"), F.col("name").alias("entity"), F.col("type").alias("entity_type"), "tier").select(normal(F.col("_form")).alias("_key"), "entity", "entity_type", "tier")
    return names.withColumn("_key", normal(F.col(name))).join(known, "_key", "left").drop("_key")


def listed(registry: DataFrame, type_: str | None = None, tier: str | None = None) -> DataFrame:
    """Entities of a type and a tier, or of any."""
    rows = registry.where(F.col("type") == type_) if type_ else registry
    return rows.where(F.col("tier") == tier) if tier else rows
