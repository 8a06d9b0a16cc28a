"""Facts over time: a customer's order priority holds until an order of another one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import temporal as T
from lodewell.sources.tables import table

_FACTS = """c AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate, lag(o_orderpriority) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
f AS (SELECT o_custkey AS subject, o_orderkey AS key, o_orderpriority AS object, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by, lag(o_orderkey) OVER w AS supersedes
  FROM c WHERE before IS NULL OR before <> o_orderpriority WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def facts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("subject"), F.lit("priority").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("key"))
    return T.superseded(rows)


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@register("triple_supersession", f"WITH {_FACTS} SELECT subject, key, object, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, superseded_by, supersedes FROM f")
def triple_supersession(spark, sf_dir):
    return facts(spark, sf_dir).select("subject", "key", "object", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), "superseded_by", "supersedes")


@register("facts_as_of", f"WITH {_FACTS} SELECT object, count(*) AS subjects, sum(key) AS keys FROM f WHERE valid_from <= TIMESTAMP '1998-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-01') GROUP BY 1")
def facts_as_of(spark, sf_dir):
    at = F.lit("1998-06-01").cast("timestamp_ntz")
    return facts(spark, sf_dir).where(T.valid_at(at, F.col("valid_from"), F.col("valid_to"))).groupBy("object").agg(F.count("*").alias("subjects"), F.sum("key").alias("keys"))


@register(
    "fact_timeline",
    f"WITH {_FACTS} SELECT a.subject, a.key, a.object, coalesce(b.object, '(pruned)') AS replacement, strftime(a.valid_to, '%Y-%m-%d') AS closed FROM f a LEFT JOIN f b ON b.key = a.superseded_by WHERE a.superseded_by IS NOT NULL ORDER BY a.valid_to DESC, a.key DESC LIMIT 100",
)
def fact_timeline(spark, sf_dir):
    report = T.supersession_report(facts(spark, sf_dir))
    return report.orderBy(F.desc("valid_to"), F.desc("key")).limit(100).select("subject", "key", "object", "replacement", day("valid_to").alias("closed"))


@register("fact_stats", f"WITH {_FACTS} SELECT count(*) AS total, count(*) FILTER (WHERE valid_to IS NULL) AS active, count(*) FILTER (WHERE valid_to IS NOT NULL) AS expired, count(DISTINCT subject) AS subjects FROM f")
def fact_stats(spark, sf_dir):
    return T.stats(facts(spark, sf_dir))


@register("entity_facts", f"WITH {_FACTS} SELECT key, object, 'out' AS direction FROM f WHERE subject = 7")
def entity_facts(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("subject", F.col("subject").cast("string"))
    return T.about(rows, "7").select("key", "object", "direction")


@register("triple_ids", f"WITH {_FACTS} SELECT key, md5(subject || '|priority|' || object || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')) AS id FROM f")
def triple_ids(spark, sf_dir):
    since = F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss")
    return facts(spark, sf_dir).select("key", T.triple_id(F.col("subject"), F.lit("priority"), F.col("object"), since).alias("id"))


@register("overlapping_facts", f"WITH {_FACTS} SELECT count(*) AS n FROM (SELECT valid_from, lag(valid_to) OVER (PARTITION BY subject ORDER BY valid_from, key) AS stop FROM f) WHERE stop > valid_from")
def overlapping_facts(spark, sf_dir):
    return T.overlaps(facts(spark, sf_dir)).agg(F.count("*").alias("n"))


@register(
    "active_mentions",
    f"WITH {_FACTS} SELECT subject, CASE subject % 4 WHEN 0 THEN 'mentions_person' WHEN 1 THEN 'mentions_org' ELSE 'mentions_project' END AS predicate, object FROM f WHERE valid_to IS NULL AND subject % 4 <> 3",
)
def active_mentions(spark, sf_dir):
    k = F.col("subject") % 4
    rows = facts(spark, sf_dir).withColumn("predicate", F.when(k == 0, "mentions_person").when(k == 1, "mentions_org").when(k == 2, "mentions_project").otherwise("knows"))
    return T.active_mentions(rows)


@register("top_predicates", f"WITH {_FACTS} SELECT 'p' || (subject % 23) AS predicate, count(*) AS n FROM f WHERE valid_to IS NULL GROUP BY 1 ORDER BY n DESC, predicate LIMIT 10")
def top_predicates(spark, sf_dir):
    return T.top_predicates(facts(spark, sf_dir).withColumn("predicate", F.concat(F.lit("p"), (F.col("subject") % 23).cast("string"))))
