"""Text-mining queries over conversations, documents and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.functions import text as T
from lodewell.operators import entities as E
from lodewell.operators import mining as M
from lodewell.operators import relational as R
from lodewell.sources.tables import NOTES_SQL, documents, notes, table


@register(
    "turn_pairing",
    """WITH g AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)
SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS turn, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text FROM g WHERE e > 0 GROUP BY conv_id, e""",
)
def turn_pairing(spark, sf_dir):
    return M.turn_pairs(table(spark, sf_dir, "conversations"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_FOUND = " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS pos, '{kind}' AS kind, unnest(regexp_extract_all(text, '{_quoted(pattern)}', 1)) AS phrase FROM conversations" for i, (kind, pattern) in enumerate(M.PREFERENCES))


@register(
    "preference_mining",
    f"""WITH f AS ({_FOUND}), c AS (SELECT conv_id, turn, pos, kind, regexp_replace(regexp_replace(phrase, '\\s+', ' ', 'g'), '^[,;:\\s]+|[,;:\\s]+$', '', 'g') AS phrase FROM f)
SELECT conv_id, turn, arg_min(kind, pos) AS kind, lower(phrase) AS phrase FROM c WHERE length(phrase) >= 10 GROUP BY conv_id, turn, lower(phrase)""",
)
def preference_mining(spark, sf_dir):
    found = M.preferences(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    return found.withColumn("phrase", F.lower("phrase"))


@register("memory_extraction")
def memory_extraction(spark, sf_dir):
    return M.memories(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").groupBy("category").agg(F.count("*").alias("n"))


@register("entity_detection")
def entity_detection(spark, sf_dir):
    return E.entities(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


@register("entity_registry")
def entity_registry(spark, sf_dir):
    return M.registry(E.entities(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text"), "doc_id")


@register("entity_backfill")
def entity_backfill(spark, sf_dir):
    rows = notes(spark, sf_dir).withColumn("archived", F.col("doc_id") % 10 == 0)
    registry, _ = E.backfill(rows, 0.55, ("de",))
    return registry.select("type", "key", "name", "occurrences", "path", "tier")


#: Names that conversations, told as who met whom where, tie together; stated so that each rule has cases.
_MET = """met AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dr Ada ' || n WHEN 1 THEN 'the ' || n || ' team' WHEN 2 THEN 'mail from ' || n || ' about it' ELSE n || ' Inc' END AS text,
  CASE c_custkey % 4 WHEN 0 THEN 'Ada ' || n ELSE n END AS name, c_custkey % 4 AS k, n FROM (SELECT c_custkey, upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2)) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey))"""


@register(
    "entity_boosts",
    f"""WITH {_MET.replace("n_name, 1, 1", "translate(n_name, '_ 0123456789#', ''), 1, 1").replace("n_name, 2", "translate(n_name, '_ 0123456789#', ''), 2")}, f AS (
  SELECT c_custkey, name, CASE k WHEN 0 THEN 'person' ELSE 'organization' END AS type, 0.67 AS confidence, CASE k WHEN 0 THEN 'preceded_by_title' WHEN 1 THEN 'org_team_pattern' ELSE 'legal_suffix' END AS signals, n FROM met WHERE k <> 2)
SELECT c_custkey, name, CASE WHEN k.tier = 'confirmed' THEN k.type ELSE f.type END AS type, round(least(0.98, confidence + CASE tier WHEN 'confirmed' THEN 0.2 WHEN 'detected' THEN 0.1 ELSE 0 END), 2) AS confidence,
  signals || coalesce(',registry_' || tier, '') AS signals FROM f LEFT JOIN (SELECT DISTINCT lower(n) AS key, 'project' AS type, CASE WHEN length(n) % 2 = 0 THEN 'confirmed' ELSE 'detected' END AS tier FROM met) k ON key = lower(name)""",
)
def entity_boosts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap(F.translate("n_name", "_ 0123456789#", "")).alias("n"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Dr Ada "), "n")).when(k == 1, F.concat(F.lit("the "), "n", F.lit(" team"))).when(k == 2, F.concat(F.lit("mail from "), "n", F.lit(" about it"))).otherwise(F.concat("n", F.lit(" Inc")))
    known = rows.select(F.col("n").alias("name"), F.lit("project").alias("type"), F.when(F.length("n") % 2 == 0, "confirmed").otherwise("detected").alias("tier")).distinct()
    return E.boosted(E.entities(rows.select("c_custkey", text.alias("text")), "c_custkey", "text"), known).drop("context")


_OPENERS = "['The', 'This', 'That', 'These', 'Those', 'Here', 'There', 'When', 'Where', 'What', 'Which', 'After', 'Before', 'Since', 'Until', 'Also', 'Just', 'Then', 'Next', 'First', 'Last', 'However', 'Moreover', 'Therefore', 'Furthermore']"
_COMMON = "['Some', 'Many', 'Most', 'Any', 'All', 'Each', 'Every', 'Other', 'Another', 'Both', 'But', 'And', 'Not', 'Yes', 'Now', 'Still', 'Already', 'Maybe', 'Could', 'Would', 'Should', 'Can', 'Will']"


@register(
    "light_entities",
    rf"""WITH n AS (SELECT doc_id, list_distinct(list_concat(list_concat(
    list_filter(regexp_extract_all(text, '\b([A-Z][a-z]+(?:[ \t\n\v\f\r]+[A-Z][a-z]+)+)\b', 1), lambda n: NOT list_contains({_OPENERS}, regexp_extract(n, '^[A-Za-z]+'))),
    regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1)),
    list_filter(flatten(list_transform(string_split(text, chr(10)), lambda s: list_transform(regexp_split_to_array(s, '[ \t\n\v\f\r]+')[2:], lambda x: regexp_replace(x, '[^a-zA-Z]', '', 'g')))), lambda x: length(x) >= 3 AND regexp_matches(x, '^[A-Z][a-z]+$') AND NOT list_contains({_OPENERS}, x) AND NOT list_contains({_COMMON}, x)))) AS names FROM documents)
SELECT doc_id, CAST(len(names) AS INTEGER) AS n, list_sort(names)[1] AS first FROM n""",
)
def light_entities(spark, sf_dir):
    names = E.light_entities(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", names.alias("names")).select("doc_id", F.size("names").alias("n"), F.try_element_at("names", F.lit(1)).alias("first"))


@register("tag_singletons", "SELECT tag, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS paths FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) || '/' || p_brand AS tag FROM part) GROUP BY tag HAVING count(*) <= 6")
def tag_singletons(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.split("p_name", " "), lambda t: F.concat(R.tag_normal(t), F.lit("/"), F.col("p_brand")))).alias("tag"))
    rare = tags.groupBy("tag").agg(F.count("*").alias("n")).where("n <= 6")
    listed = tags.join(rare, "tag").groupBy("tag").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("paths"))  # six at most
    return listed.select("tag", "n", F.array_join(F.transform("paths", lambda p: p.cast("string")), ",").alias("paths"))


@register("tag_cloud", f"WITH {NOTES_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY tag HAVING count(*) >= 2 ORDER BY n DESC, tag LIMIT 20")
def tag_cloud(spark, sf_dir):
    return notes(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "tag").limit(20)


@register(
    "status_overview",
    f"WITH {NOTES_SQL} SELECT coalesce(collection, '*') AS collection, coalesce(CASE WHEN heat >= 10 THEN 'hot' WHEN heat >= 4 THEN 'warm' ELSE 'cold' END, '*') AS temperature, count(*) AS n FROM notes GROUP BY GROUPING SETS ((collection), (CASE WHEN heat >= 10 THEN 'hot' WHEN heat >= 4 THEN 'warm' ELSE 'cold' END), ())",
)
def status_overview(spark, sf_dir):
    from lodewell.functions.scoring import temperature

    rows = notes(spark, sf_dir).select("collection", temperature(F.col("heat")).alias("temperature"))
    sets = rows.groupingSets([[F.col("collection")], [F.col("temperature")], []], "collection", "temperature").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("collection", F.lit("*")).alias("collection"), F.coalesce("temperature", F.lit("*")).alias("temperature"), "n")


@register(
    "stable_ids",
    "SELECT p_partkey, substring(sha1('tpch|' || p_brand || '|' || p_name || '|' || p_type || '|' || CASE WHEN p_size % 5 = 0 THEN '<no-sig>' ELSE p_name || ' ' || p_size END), 1, 16) AS id FROM part",
)
def stable_ids(spark, sf_dir):
    signature = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", M.symbol_id(F.lit("tpch"), F.col("p_brand"), F.col("p_name"), F.col("p_type"), signature).alias("id"))


@register(
    "symbol_delta",
    """WITH a AS (SELECT p_partkey, p_name AS s FROM part WHERE p_partkey % 13 <> 5), b AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_name || '(x)' ELSE p_name END AS s FROM part WHERE p_partkey % 17 <> 3)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_partkey IS NULL THEN 'added' ELSE 'sig_changed' END AS change FROM a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey WHERE a.s IS NULL OR b.s IS NULL OR a.s <> b.s""",
)
def symbol_delta(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = part.where("p_partkey % 17 <> 3").withColumn("p_name", F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit("(x)"))).otherwise(F.col("p_name")))
    return M.symbol_delta(part.where("p_partkey % 13 <> 5"), after, ["p_partkey"], "p_name")


@register(
    "change_log_truncated",
    "WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) SELECT o_orderkey, day, (SELECT count(*) > 100 FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'P') AS truncated FROM t",
)
def change_log_truncated(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "P"))
    page = R.page_of(rows.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 0, 100)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("has_more").alias("truncated"))


@register(
    "title_slugs",
    f"WITH {NOTES_SQL} SELECT doc_id, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM notes",
)
def title_slugs(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", T.slug(F.col("title")).alias("slug"), T.token_estimate(F.col("content")).alias("tokens"))


@register(
    "scalar_text",
    f"""WITH {NOTES_SQL}, t AS (SELECT doc_id, list_filter(list_transform(string_split(content, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS lines FROM notes), s AS (SELECT doc_id, trim(regexp_split_to_array(coalesce(regexp_replace(lines[1], '^#+\\s*', ''), ''), '[.!?]')[1], ' ') AS s FROM t)
SELECT doc_id, CASE WHEN s = '' THEN 'Untitled Memory' WHEN length(s) > 80 THEN s[1:77] || '...' ELSE s END AS title,
  CASE WHEN doc_id * 7 < 90 THEN doc_id * 7 || 's ago' WHEN doc_id * 7 // 60 < 90 THEN doc_id * 7 // 60 || 'm ago' WHEN doc_id * 7 // 3600 < 36 THEN doc_id * 7 // 3600 || 'h ago' ELSE doc_id * 7 // 86400 || 'd ago' END AS age FROM s""",
)
def scalar_text(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", T.prose_title(F.col("content")).alias("title"), T.humanised_age(F.col("doc_id") * 7).alias("age"))


@register(
    "repository_origins",
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'host.org/o' || page_id || '/r' ELSE lower(regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '/+$', '')) END AS origin FROM pages",
)
def repository_origins(spark, sf_dir):
    own = F.concat(F.lit("  git@Host.org:O"), F.col("page_id").cast("string"), F.lit("/r.git/ "))
    url = F.when(F.col("page_id") % 3 == 0, own).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.origin(url).alias("origin"))


@register(
    "first_links",
    """WITH p AS (SELECT p_partkey, p_name || ' and ' || p_name || ' or [[red]] ' || p_type AS t FROM part), a AS (SELECT p_partkey, regexp_replace(t, '^(.*?)\\b(widget)\\b', '\\1[[\\2]]') AS t FROM p)
SELECT p_partkey, CASE WHEN starts_with(t, 'red ') THEN '[[red]]' || t[4:] ELSE t END AS t FROM a""",
)
def first_links(spark, sf_dir):
    text = F.concat("p_name", F.lit(" and "), "p_name", F.lit(" or [[red]] "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.linked_once(text, ["red", "widget"]).alias("t"))


@register(
    "preference_remarks",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'convention' WHEN 2 THEN 'pain_point' WHEN 3 THEN 'preference' END AS kind,
  CASE p_partkey % 5 WHEN 0 THEN p_name || ' over anything else' WHEN 1 THEN p_name || ' in every single build' WHEN 2 THEN 'the old ' || p_name || ' part' WHEN 3 THEN 'wrap a ' || p_name || ' twice' END AS phrase FROM part WHERE p_partkey % 5 <> 4""",
)
def preference_remarks(spark, sf_dir):
    """What people would say about parts: one remark of each kind, and one that says nothing."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    say = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    text = F.when(k == 0, say("Well. I prefer ", " over anything else.")).when(k == 1, say("Our team uses ", " in every single build.")).when(k == 2, say("the old ", " part is really annoying")).when(k == 3, say("As you know, I usually wrap a ", " twice.")).otherwise(say("A ", " is on the table."))
    return M.preferences(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")


@register(
    "memory_remarks",
    """WITH r AS (SELECT p_partkey, p_partkey % 6 AS k, p_name FROM part), f AS (
  SELECT p_partkey, CASE k WHEN 0 THEN 'decision' WHEN 1 THEN 'preference' WHEN 2 THEN 'milestone' WHEN 3 THEN 'problem' WHEN 4 THEN 'fact' END AS category,
  CASE k WHEN 0 THEN 'We went with the ' || p_name || ' after all.' WHEN 1 THEN 'Everyone knows that I love the ' || p_name || '.' WHEN 2 THEN 'The ' || p_name || ' went live today.' WHEN 3 THEN 'There is a regression in the ' || p_name || '.' WHEN 4 THEN 'All of it is hosted at the ' || p_name || ' site.' END AS sentence FROM r WHERE k < 5)
SELECT * FROM f UNION ALL SELECT p_partkey, 'decision', 'Then somebody picked another one.' FROM r WHERE k < 5""",
)
def memory_remarks(spark, sf_dir):
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    say = lambda a, b: F.concat(F.lit(a), name, F.lit(b + " Then somebody picked another one. then somebody waited."))
    text = F.when(k == 0, say("We went with the ", " after all.")).when(k == 1, say("Everyone knows that I love the ", ".")).when(k == 2, say("The ", " went live today.")).when(k == 3, say("There is a regression in the ", ".")).when(k == 4, say("All of it is hosted at the ", " site.")).otherwise(say("Nothing to say on the ", ". Really!").substr(1, 25))
    found = M.memories(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")
    return found.withColumn("sentence", F.regexp_replace("sentence", " then somebody waited[.]$", ""))
