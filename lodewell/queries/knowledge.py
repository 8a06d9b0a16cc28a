"""Knowledge-graph queries over notes and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import knowledge as K
from lodewell.sources.tables import NOTES_SQL, notes, table


@register(
    "kg_bootstrap",
    f"""WITH {NOTES_SQL}, t AS (SELECT path AS subject, 'in_collection' AS predicate, collection AS object, 1.0 AS confidence FROM notes UNION ALL SELECT path, 'tagged', unnest(tags), 1.0 FROM notes)
SELECT predicate, object, count(*) AS n, max(confidence) AS confidence FROM (SELECT DISTINCT * FROM t) GROUP BY 1, 2""",
)
def kg_bootstrap(spark, sf_dir):
    rows = notes(spark, sf_dir).select("path", "collection", "tags", F.array().cast("array<string>").alias("links"))
    return K.bootstrap(rows).groupBy("predicate", "object").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@register(
    "top_entities_by_degree",
    "WITH d AS (SELECT 'c' || o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1) SELECT entity, sum(n) AS degree FROM d GROUP BY entity ORDER BY degree DESC, entity LIMIT 10",
)
def top_entities_by_degree(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ends = F.explode(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderpriority"))).alias("entity")
    return orders.select(ends).groupBy("entity").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "entity").limit(10)


@register(
    "call_resolution",
    """WITH symbols AS (SELECT c_nationkey AS repo_id, c_mktsegment AS name, c_custkey AS id FROM customer WHERE c_acctbal > 9500), imports AS (SELECT n_nationkey AS repo_id, (n_nationkey + 1) % 25 AS target FROM nation),
allowed AS (SELECT DISTINCT repo_id, repo_id AS target FROM symbols UNION SELECT repo_id, target FROM imports), one AS (SELECT a.repo_id, s.name, min(s.id) AS callee_id FROM allowed a JOIN symbols s ON s.repo_id = a.target GROUP BY 1, 2 HAVING count(*) = 1)
SELECT c_custkey AS caller_id, callee_id FROM customer LEFT JOIN one ON one.repo_id = c_nationkey AND one.name = c_mktsegment""",
)
def call_resolution(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id"), "c_acctbal")
    imports = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repo_id"), ((F.col("n_nationkey") + 1) % 25).alias("resolved_repo"))
    calls = people.select("repo_id", F.col("id").alias("caller_id"), F.col("name").alias("callee_name"))
    return K.resolved_calls(calls, people.where("c_acctbal > 9500"), imports).select("caller_id", "callee_id")


@register(
    "innermost_interval",
    """WITH spans AS (SELECT o_custkey AS path, o_orderkey AS name, o_orderkey AS start_line, o_orderkey + CAST(floor(o_totalprice / 1000) AS BIGINT) AS end_line FROM orders), spots AS (SELECT DISTINCT o_custkey AS path, o_orderkey + 5 AS line FROM orders)
SELECT p.path, p.line, arg_min(name, (end_line - start_line, name)) AS symbol FROM spots p LEFT JOIN spans s ON s.path = p.path AND p.line BETWEEN start_line AND end_line GROUP BY 1, 2""",
)
def innermost_interval(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    spans = orders.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("name"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 1000)).alias("end_line"))
    at = orders.select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") + 5).alias("line")).distinct()
    return K.enclosing(at, spans)


@register(
    "strongest_edges",
    """WITH p AS (SELECT c_nationkey AS a, o_orderpriority AS b, count(*) AS w FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), e AS (SELECT 'n' || a AS src, b AS dst, w FROM p UNION ALL SELECT b, 'n' || a, w FROM p),
k AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM e) WHERE place <= 4)
SELECT k.src, k.dst, k.w FROM k JOIN k r ON r.src = k.dst AND r.dst = k.src""",
)
def strongest_edges(spark, sf_dir):
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("a"))
    pairs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("b")).join(nation, "o_custkey").groupBy("a", "b").agg(F.count("*").alias("w"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    return K.strongest_edges(both, 4)


@register("vault_by_extension", "SELECT lower(regexp_extract(url, '\\.([^./?#]+)([?#].*)?$', 1)) AS extension, count(*) AS files FROM pages GROUP BY 1")
def vault_by_extension(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return K.health_by_extension(table(spark, sf_dir, "pages").select(path.alias("path")))
