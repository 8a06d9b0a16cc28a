"""Queries on the registry of entities, dead code, intervals that overlap, and themes in two phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import entities as E
from lodewell.operators import knowledge as K
from lodewell.operators import lifecycle as L
from lodewell.operators import registry as G
from lodewell.operators import temporal as T
from lodewell.queries.codenav import _CODE, symbols
from lodewell.sources import walk
from lodewell.sources.tables import NOTES_SQL, notes, table

#: Orders as sightings of their customers; a bill's whole amount is an alias, so customers with one amount in common are one entity.
_SIGHTINGS = """sightings AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Customer  ' ELSE 'customer ' END || o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN 'person' WHEN 'O' THEN 'organization' ELSE 'project' END AS type,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 3 WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 1 END AS rank, 'bill ' || CAST(floor(o_totalprice) AS BIGINT) AS alias, 'orders/' || o_orderkey AS note_path, CAST(o_orderdate AS DATE) AS seen,
         'customer ' || o_custkey AS key FROM orders
), links AS (
  SELECT DISTINCT a.key AS a, b.key AS b FROM sightings a JOIN sightings b ON a.alias = b.alias
), roots AS (
  SELECT a AS key, a AS root FROM links UNION SELECT b, root FROM roots JOIN links ON links.a = roots.key
), root AS (
  SELECT key, min(root) AS root FROM roots GROUP BY key
), entities AS (
  SELECT root, arg_min(name, (seen, name)) AS name, arg_min(type, (seen, name, type)) AS type, min(seen) AS first_seen, max(seen) AS last_seen, min(note_path) AS note_path, max(rank) AS rank, count(*) AS occurrences, count(DISTINCT key) + count(DISTINCT alias) - 1 AS aliases
  FROM sightings JOIN root USING (key) GROUP BY root
)"""


def sightings(spark, sf_dir):
    key, status = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "confirmed").when(F.col("o_orderpriority") == "2-HIGH", "detected").otherwise("suggested")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Customer  ").otherwise("customer "), key).alias("name"),
        F.when(status == "F", "person").when(status == "O", "organization").otherwise("project").alias("type"),
        urgent.alias("tier"),
        F.array(F.concat(F.lit("bill "), F.floor("o_totalprice").cast("string"))).alias("aliases"),
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("note_path"),
        F.col("o_orderdate").cast("date").alias("seen"),
    )


def registry(spark, sf_dir):
    """The registry after two merges: the first half of the years, then the others into what is stored."""
    rows = sightings(spark, sf_dir)
    early = F.col("seen") < F.lit("1998-01-01").cast("date")
    return G.merged(rows.where(~early), G.merged(rows.where(early)))


@register(
    "alias_registry",
    f"WITH RECURSIVE {_SIGHTINGS} SELECT name, type, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen, note_path, CASE rank WHEN 3 THEN 'confirmed' WHEN 2 THEN 'detected' ELSE 'suggested' END AS tier, rank = 3 AS confirmed, occurrences, CAST(aliases AS INTEGER) AS aliases FROM entities",
)
def alias_registry(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return registry(spark, sf_dir).select("name", "type", day("first_seen"), day("last_seen"), "note_path", "tier", "confirmed", "occurrences", F.size("aliases").alias("aliases"))


@register(
    "alias_lookup",
    f"""WITH RECURSIVE {_SIGHTINGS}, known AS (SELECT DISTINCT alias AS form, root FROM sightings JOIN root USING (key) UNION SELECT key, root FROM root)
SELECT c_custkey, name AS entity, CASE rank WHEN 3 THEN 'confirmed' WHEN 2 THEN 'detected' WHEN 1 THEN 'suggested' END AS tier FROM customer LEFT JOIN known ON form = CASE WHEN c_custkey % 2 = 0 THEN 'customer ' || c_custkey ELSE 'bill ' || CAST(floor(c_acctbal * 20) AS BIGINT) END LEFT JOIN entities USING (root)""",
)
def alias_lookup(spark, sf_dir):
    asked = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" CUSTOMER "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("Bill "), F.floor(F.col("c_acctbal") * 20).cast("string")))
    return G.resolved(table(spark, sf_dir, "customer").select("c_custkey", asked.alias("name")), registry(spark, sf_dir)).select("c_custkey", "entity", "tier")


@register("registry_counts", f"WITH RECURSIVE {_SIGHTINGS} SELECT CASE rank WHEN 3 THEN 'confirmed' WHEN 2 THEN 'detected' ELSE 'suggested' END AS tier, type, count(*) AS entities, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM entities GROUP BY 1, 2")
def registry_counts(spark, sf_dir):
    return registry(spark, sf_dir).groupBy("tier", "type").agg(F.count("*").alias("entities"), F.sum("occurrences").alias("occurrences"))


@register(
    "dead_code",
    f"""WITH {_CODE}, s AS (SELECT *, CASE id % 9 WHEN 0 THEN 'handler' WHEN 1 THEN '_start' ELSE name END AS called, CASE id % 7 WHEN 0 THEN 'src/__tests__/a.ts' WHEN 1 THEN 'src/a.spec.ts' WHEN 2 THEN 'src/latests/a.ts' ELSE 'src/main.ts' END AS path FROM symbols)
SELECT id, name FROM s WHERE kind <> 'class' AND called NOT IN ('handler', '_start') AND id % 7 NOT IN (0, 1) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = s.id AND l_quantity >= 49)""",
)
def dead_code(spark, sf_dir):
    i = F.col("id")
    named = F.when(i % 9 == 0, "handler").when(i % 9 == 1, "_start").otherwise(F.col("name"))
    path = F.when(i % 7 == 0, "src/__tests__/a.ts").when(i % 7 == 1, "src/a.spec.ts").when(i % 7 == 2, "src/latests/a.ts").otherwise("src/main.ts")
    rows = symbols(spark, sf_dir)
    called = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") >= 49, F.col("l_partkey")).alias("callee_id"))
    dead = K.dead_symbols(rows.withColumn("name", named).withColumn("relative_path", path), called)
    return rows.select("id", "name").join(dead.select("id"), "id")


#: A customer's orders as intervals of some days, open ones for pending orders.
_SPANS = """spans AS (SELECT o_custkey AS subject, o_orderpriority AS predicate, o_orderkey AS key, o_orderdate AS valid_from, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 400 + 1 AS INTEGER)) END AS valid_to FROM orders)"""


def spans(spark, sf_dir):
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 400 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "P", end).alias("valid_to"))


@register(
    "interval_overlaps",
    f"""WITH {_SPANS} SELECT key FROM spans b WHERE EXISTS (SELECT 1 FROM spans a WHERE a.subject = b.subject AND a.predicate = b.predicate AND a.key <> b.key AND (a.valid_to IS NULL OR a.valid_to > b.valid_from)
  AND (a.valid_from, a.valid_to IS NULL, coalesce(a.valid_to, TIMESTAMP '2000-01-01'), a.key) < (b.valid_from, b.valid_to IS NULL, coalesce(b.valid_to, TIMESTAMP '2000-01-01'), b.key))""",
)
def interval_overlaps(spark, sf_dir):
    return T.overlaps(spans(spark, sf_dir)).select("key")


@register(
    "interval_islands",
    f"""WITH {_SPANS}, starts AS (SELECT subject, predicate, valid_from AS first FROM spans b WHERE NOT EXISTS (SELECT 1 FROM spans a WHERE a.subject = b.subject AND a.predicate = b.predicate AND a.valid_from < b.valid_from AND (a.valid_to IS NULL OR a.valid_to >= b.valid_from)) GROUP BY ALL),
i AS (SELECT s.subject, s.predicate, (SELECT max(first) FROM starts t WHERE t.subject = s.subject AND t.predicate = s.predicate AND t.first <= s.valid_from) AS first, valid_to FROM spans s)
SELECT subject, predicate, strftime(first, '%Y-%m-%d') AS first, CASE WHEN count(*) = count(valid_to) THEN strftime(max(valid_to), '%Y-%m-%d') END AS last, count(*) AS facts FROM i GROUP BY subject, predicate, i.first""",
)
def interval_islands(spark, sf_dir):
    return T.islands(spans(spark, sf_dir)).select("subject", "predicate", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "facts")


@register(
    "interval_repair",
    f"""WITH {_SPANS}, n AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, valid_to NULLS LAST, key) AS next FROM spans)
SELECT subject, count(*) AS facts, count(valid_to) AS closed, max(strftime(valid_to, '%Y-%m-%d')) AS last FROM (SELECT subject, valid_from, CASE WHEN next IS NULL THEN valid_to ELSE least(coalesce(valid_to, next), next) END AS valid_to FROM n) WHERE valid_to IS NULL OR valid_to > valid_from GROUP BY subject""",
)
def interval_repair(spark, sf_dir):
    mended = T.repaired(spans(spark, sf_dir))
    return mended.groupBy("subject").agg(F.count("*").alias("facts"), F.count("valid_to").alias("closed"), F.max(F.date_format("valid_to", "yyyy-MM-dd")).alias("last"))


@register(
    "themes_of_notes",
    f"""WITH {NOTES_SQL}, k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS temperature, CASE WHEN doc_id % 4 = 0 THEN ['len' || (n_chars // 300)] ELSE tags END AS tags FROM notes),
p AS (SELECT least(tags[1], tags[2]) || ' + ' || greatest(tags[1], tags[2]) AS theme, doc_id, temperature, 0 AS phase FROM k WHERE len(tags) = 2 AND tags[1] <> tags[2] AND temperature <> 'cold'
  UNION ALL SELECT tags[1], doc_id, temperature, 1 FROM k WHERE (len(tags) = 1 OR tags[1] = tags[2]) AND temperature <> 'cold'),
t AS (SELECT theme, phase, count(*) AS size, min(doc_id) AS first, CASE WHEN count(*) FILTER (temperature = 'hot') >= count(*) FILTER (temperature = 'warm') THEN 'hot' ELSE 'warm' END AS temperature FROM p GROUP BY theme, phase HAVING count(*) >= CASE phase WHEN 0 THEN 2 ELSE 5 END)
SELECT theme, size, first, temperature, CAST(row_number() OVER (ORDER BY phase, size DESC, theme) AS INTEGER) AS place FROM t""",
)
def themes_of_notes(spark, sf_dir):
    i = F.col("doc_id")
    heat = F.when(i % 3 == 0, "hot").when(i % 3 == 1, "warm").otherwise("cold")
    tags = F.when(i % 4 == 0, F.array(F.concat(F.lit("len"), F.floor(F.col("n_chars") / 300).cast("string")))).otherwise(F.col("tags"))
    return L.note_themes(notes(spark, sf_dir).select(i.alias("key"), tags.alias("tags"), heat.alias("temperature"))).select("theme", "size", "first", "temperature", "place")


#: Customers as notes that name people, teams and firms, so that each strong signal has cases.
_TOLD = """told AS (SELECT c_custkey, n, CASE c_custkey % 6 WHEN 0 THEN 'Talk to Dr ' || n || ' Smith' WHEN 1 THEN 'the ' || n || ' Team came' WHEN 2 THEN n || ' v2.4 is out' WHEN 3 THEN 'see [[People/' || n || ' Doe]] and [[2024-01-02]]' WHEN 4 THEN 'bought by ' || n || ' GmbH' ELSE 'code at github.com/x/' || lower(n) || '-app' END AS text
  FROM (SELECT c_custkey, upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) AS n FROM customer))"""


@register(
    "strong_entities",
    f"""WITH {_TOLD} SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN n || ' Smith' WHEN 3 THEN n || ' Doe' WHEN 5 THEN lower(n) || '-app' ELSE n END AS name, CASE c_custkey % 6 WHEN 0 THEN 'person' WHEN 3 THEN 'person' WHEN 2 THEN 'project' WHEN 5 THEN 'project' ELSE 'organization' END AS type, 0.67 AS confidence,
  CASE c_custkey % 6 WHEN 0 THEN 'preceded_by_title' WHEN 1 THEN 'org_team_pattern' WHEN 2 THEN 'versioned_name' WHEN 3 THEN 'wiki_link' WHEN 4 THEN 'legal_suffix' ELSE 'repo_url' END AS signals, text AS context FROM told""",
)
def strong_entities(spark, sf_dir):
    n, k = F.initcap("c_mktsegment"), F.col("c_custkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Talk to Dr "), n, F.lit(" Smith")))
        .when(k == 1, F.concat(F.lit("the "), n, F.lit(" Team came")))
        .when(k == 2, F.concat(n, F.lit(" v2.4 is out")))
        .when(k == 3, F.concat(F.lit("see [[People/"), n, F.lit(" Doe]] and [[2024-01-02]]")))
        .when(k == 4, F.concat(F.lit("bought by "), n, F.lit(" GmbH")))
        .otherwise(F.concat(F.lit("code at github.com/x/"), F.lower(n), F.lit("-app")))
    )
    return E.entities(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text", only=[s for s in E.STRONG])


@register(
    "orphan_memories",
    """WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' WHEN 2 THEN 'cold' END AS temperature, doc_id % 17 AS heat, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tags, doc_id % 5 = 0 AS linked, doc_id % 11 = 0 AS archived, CASE WHEN doc_id % 2 = 0 THEN doc_id % 90 END AS days FROM documents),
o AS (SELECT doc_id, coalesce(temperature, 'cold') AS temperature, heat, coalesce(days, -1) AS days, tags FROM k WHERE NOT archived AND ((tags = 0 AND NOT linked) OR ((tags > 0) <> linked AND temperature = 'cold' AND heat <= 2)))
SELECT doc_id, temperature, CAST(days AS INTEGER) AS days, CASE temperature WHEN 'hot' THEN 'link' WHEN 'warm' THEN 'review' ELSE CASE WHEN tags >= 2 THEN 'consolidate' WHEN heat <= 2 THEN 'archive' ELSE 'review' END END AS action,
  CAST(row_number() OVER (ORDER BY CASE temperature WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, heat DESC, doc_id) AS INTEGER) AS place FROM o""",
)
def orphan_memories(spark, sf_dir):
    i, day = F.col("doc_id"), F.lit("2024-06-01").cast("date")
    pick = F.when(i % 4 == 0, "hot").when(i % 4 == 1, "warm").when(i % 4 == 2, "cold")
    tags = F.slice(F.array("lang", "source"), F.lit(1), (i % 3).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        i.alias("key"), F.lit("t").alias("title"), F.when(i % 5 == 0, "see [[x]]").otherwise("text").alias("content"), tags.alias("tags"), pick.alias("temperature"), (i % 17).alias("heat_score"), F.when(i % 2 == 0, F.date_sub(day, (i % 90).cast("int"))).alias("last_accessed"), (i % 11 == 0).alias("archived")
    )
    return L.orphan_memories(rows, day).select(F.col("key").alias("doc_id"), "temperature", "days", "action", "place")


@register(
    "walked_paths",
    """SELECT lang || '/' || source || '/' || doc_id || '.py' AS path FROM documents WHERE NOT (lang = 'de' AND source = 'src1') AND NOT CASE WHEN lang = 'fr' THEN doc_id % 10 = 3 ELSE doc_id % 10 = 7 END""",
)
def walked_paths(spark, sf_dir):
    """Documents as files of a repository with ignore files at its root and in one folder."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py")))
    files = spark.createDataFrame([(".gitignore", "*7.py\n/de/src1/\n"), ("fr/.gitignore", "!*7.py\n*3.py\n")], "path string, content string")
    return walk.walked(table(spark, sf_dir, "documents").select(path.alias("path")), walk.ignore_rules(files)).select("path")
