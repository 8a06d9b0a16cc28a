"""Bitemporal facts (subject, predicate, object, valid_from, key): supersession, as-of, timelines, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def triple_id(subject: Column, predicate: Column, object_: Column, since: Column) -> Column:
    """One id for each interval of a fact; parts are separated, so no two facts share one."""
    return F.md5(F.concat_ws("|", subject.cast("string"), predicate, object_, since.cast("string")))


def superseded(facts: DataFrame, key: str = "key") -> DataFrame:
    """Each assertion that changes the object, closed by the next one: valid_to, supersedes, superseded_by.

    An assertion of the same object again changes nothing. Order is valid_from, then the key.
    """
    by = Window.partitionBy("subject", "predicate").orderBy("valid_from", key)
    changes = facts.withColumn("_before", F.lag("object").over(by)).where(F.col("_before").isNull() | (F.col("_before") != F.col("object"))).drop("_before")
    return changes.withColumn("valid_to", F.lead("valid_from").over(by)).withColumn("superseded_by", F.lead(key).over(by)).withColumn("supersedes", F.lag(key).over(by))


def valid_at(instant: Column, since: Column, until: Column) -> Column:
    """Half-open: from `since` on, before `until`; a missing bound is open."""
    return F.coalesce(since <= instant, F.lit(True)) & F.coalesce(instant < until, F.lit(True))


def valid_on(day: str, since: Column, until: Column) -> Column:
    """The same for text dates of mixed precision, compared by day."""
    return F.coalesce(F.substring(since, 1, 10) <= day[:10], F.lit(True)) & F.coalesce(F.lit(day[:10]) < F.substring(until, 1, 10), F.lit(True))


def about(facts: DataFrame, entity, direction: str = "both") -> DataFrame:
    """Facts that name the entity as subject (out) or object (in), marked with the direction; both count once."""
    out = facts.where(F.col("subject") == entity).withColumn("direction", F.lit("out"))
    into = facts.where((F.col("object") == entity) & ~F.coalesce(F.col("subject") == entity, F.lit(False))).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def invalidated(facts: DataFrame, which: Column, at: Column) -> DataFrame:
    """Closes the chosen facts that are still open; closed ones keep their end."""
    hit = which & F.col("valid_to").isNull()
    return facts.withColumn("invalidated_at", F.when(hit, at)).withColumn("valid_to", F.when(hit, at).otherwise(F.col("valid_to")))


def supersession_report(closed: DataFrame, key: str = "key") -> DataFrame:
    """Closed facts with the object that replaced them, `(pruned)` where it is gone."""
    later = closed.select(F.col(key).alias("superseded_by"), F.col("object").alias("replacement"))
    return closed.where(F.col("superseded_by").isNotNull()).join(later, "superseded_by", "left").withColumn("replacement", F.coalesce("replacement", F.lit("(pruned)")))


def stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("total"), F.count_if(F.col("valid_to").isNull()).alias("active"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.countDistinct("subject").alias("subjects"))


def _swept(facts: DataFrame) -> tuple[DataFrame, Column]:
    """Facts with `_reach`, the furthest end of what begins before them, and the end that an open one stands for.

    Order is the begin, then the end, then what the columns hold, so it is one order for equal facts too.
    """
    ends = facts.withColumn("_open", F.col("valid_to").isNull())
    others = [c for c in facts.columns if c not in ("subject", "predicate", "valid_from", "valid_to") and not dict(facts.dtypes)[c].startswith("map")]
    order = [F.col("valid_from").asc_nulls_first(), F.col("_open"), F.col("valid_to"), *others]
    before = Window.partitionBy("subject", "predicate").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swept = ends.withColumn("_reach", F.max("valid_to").over(before)).withColumn("_endless", F.coalesce(F.max("_open").over(before), F.lit(False)))
    begins = F.col("valid_from").isNull() | (F.col("_reach") > F.col("valid_from"))  # a missing begin lies before all
    return swept, F.col("_endless") | (begins & F.col("_reach").isNotNull())


def overlaps(facts: DataFrame) -> DataFrame:
    """Integrity: facts of one subject and predicate that begin before one of those that began before them ends.

    One sorted pass with the furthest end so far, so nested and open intervals are found; an interval
    without begin or end is open there. Half-open: one that begins where another ends overlaps nothing.
    """
    swept, hit = _swept(facts)
    return swept.where(hit).select(*facts.columns)


def islands(facts: DataFrame) -> DataFrame:
    """(subject, predicate, first, last, facts): stretches of time without a gap, of all facts that overlap or meet one another; `last` is null if one is open."""
    swept, _ = _swept(facts)
    fresh = ~F.col("_endless") & F.coalesce(F.col("_reach") < F.col("valid_from"), F.col("_reach").isNull())
    number = F.sum(fresh.cast("int")).over(Window.partitionBy("subject", "predicate").orderBy(F.col("valid_from").asc_nulls_first(), "_open", "valid_to").rowsBetween(Window.unboundedPreceding, 0))
    each = swept.withColumn("_island", number).groupBy("subject", "predicate", "_island")
    last = F.when(~F.max("_open"), F.max("valid_to")).alias("last")
    return each.agg(F.when(F.count("valid_from") == F.count("*"), F.min("valid_from")).alias("first"), last, F.count("*").alias("facts")).drop("_island")


def repaired(facts: DataFrame) -> DataFrame:
    """Facts without overlaps: each one ends, at the latest, where the next one of its subject and predicate begins; what is empty then goes."""
    by = Window.partitionBy("subject", "predicate").orderBy(F.col("valid_from").asc_nulls_first(), F.col("valid_to").asc_nulls_last(), *[c for c in facts.columns if c not in ("subject", "predicate", "valid_from", "valid_to")])
    following = F.lead("valid_from").over(by)
    clipped = facts.withColumn("_next", following).withColumn("valid_to", F.when(F.col("_next").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_next"))), F.col("_next")).otherwise(F.col("valid_to")))
    return clipped.where(F.col("valid_to").isNull() | F.col("valid_from").isNull() | (F.col("valid_from") < F.col("valid_to"))).drop("_next")


#: Sentence patterns of single-valued facts, as (predicate, pattern, group of the subject, group of the object).
FACT_RULES = [
    ("office_location", r"(?i)\bthe ([\w ]+?) office (?:is|moved|relocated) (?:now )?(?:in|to) ([A-Z]\w+)", 1, 2),
    ("tech_lead_of", r"\b([A-Z]\w+) is (?:now )?the tech lead (?:of|for) ([\w ]+?)[.,]", 2, 1),
    ("primary_database", r"(?i)\b(?:the )?primary database (?:of|for) ([\w ]+?) is (?:now )?(\w+)", 1, 2),
]


def extract_facts(texts: DataFrame, text: str) -> DataFrame:
    """(columns of texts, predicate, subject, object) of the sentences that the rules know."""
    found = F.array(*[F.struct(F.lit(p).alias("predicate"), F.regexp_extract(text, rx, s).alias("subject"), F.regexp_extract(text, rx, o).alias("object")) for p, rx, s, o in FACT_RULES])
    return texts.select("*", F.explode(F.filter(found, lambda f: f["subject"] != "")).alias("fact")).select(*texts.columns, "fact.*")


#: Predicates of mentions.
MENTIONS = ["mentions_person", "mentions_org", "mentions_project"]


def active_mentions(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object) of mentions that still hold."""
    return facts.where(F.col("predicate").isin(MENTIONS) & F.col("valid_to").isNull()).select("subject", "predicate", "object")


def top_predicates(facts: DataFrame, limit: int = 10) -> DataFrame:
    """(predicate, n) of facts that still hold, the commonest first."""
    return facts.where("valid_to IS NULL").groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(limit)
