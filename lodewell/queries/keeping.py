"""Queries of what keeps a vault: ingest and pulls, writes and merges, tasks and preferences, evaluation, staged reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.functions import text as T
from lodewell.operators import knowledge as K
from lodewell.operators import lifecycle as L
from lodewell.operators import mining as M
from lodewell.operators import relational as R
from lodewell.operators import temporal as P
from lodewell.plans import recall as plans
from lodewell.sources import code, conversations, exports, vault
from lodewell.sources.tables import NOTES_SQL, notes, table

#: Parts as Markdown files: front matter, tags, links, tasks.
_FILES = """files AS (SELECT p_partkey, p_type || '/' || p_partkey || '.md' AS path, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'tags: [#' || p_brand || ', ' || replace(p_name, ' ', ', ') || ']' || chr(10)
  || CASE WHEN p_size % 3 = 0 THEN 'valid_from: 2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00' || chr(10) ELSE '' END || '---' || chr(10)
  || 'See [[' || p_type || '|kind]] and [[code:tpch:src/' || p_brand || '.py:' || replace(p_name, ' ', '_') || ']].' || chr(10) || '- [' || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE 'x' END || '] count ' || p_size || chr(10) AS content FROM part)"""


def files(spark, sf_dir):
    day = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("valid_from: 2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00\n"))).otherwise("")
    content = F.concat(
        F.lit("---\ntitle: "), "p_name", F.lit("\ntags: [#"), "p_brand", F.lit(", "), F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lit("]\n"), day, F.lit("---\nSee [["), "p_type", F.lit("|kind]] and [[code:tpch:src/"), "p_brand",
        F.lit(".py:"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("]].\n- ["), F.when(F.col("p_size") % 2 == 0, " ").otherwise("x"), F.lit("] count "), F.col("p_size").cast("string"), F.lit("\n"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), content.alias("content"), F.lit(None).cast("timestamp").alias("modified"))


@register(
    "front_matter_notes",
    f"""WITH {_FILES} SELECT f.path, p_name AS title, p_type AS collection, lower(p_brand) || '|' || replace(p_name, ' ', '|') AS tags, CASE WHEN p_size % 3 = 0 THEN '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS valid_from,
  p_type || '|code:tpch:src/' || split_part(p_brand, '#', 1) AS links, sha256(content) AS etag FROM files f JOIN part USING (p_partkey)""",
)
def front_matter_notes(spark, sf_dir):
    rows = vault.as_notes(files(spark, sf_dir))
    return rows.select("path", "title", "collection", F.array_join("tags", "|").alias("tags"), F.col("valid_from").cast("string").alias("valid_from"), F.array_join("links", "|").alias("links"), "etag")


@register(
    "code_link_capture",
    f"""WITH {_FILES} SELECT f.path AS note, 'tpch' AS slug, 'src/' || p_brand || '.py' AS path, replace(p_name, ' ', '_') AS name FROM files f JOIN part USING (p_partkey)""",
)
def code_link_capture(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.col("path").alias("note"), F.explode(T.code_references(F.col("content"))).alias("r"))
    return rows.select("note", "r.slug", "r.path", "r.name")


@register("open_tasks", f"WITH {_FILES} SELECT path, '- [ ] count ' || p_size AS task FROM files JOIN part USING (p_partkey) WHERE p_size % 2 = 0")
def open_tasks(spark, sf_dir):
    return vault.open_tasks(files(spark, sf_dir)).select("path", F.array_join("tasks", "|").alias("task"))


@register(
    "compare_and_swap",
    f"""WITH {_FILES}, w AS (SELECT path, 'new ' || p_partkey AS content, CASE p_partkey % 3 WHEN 0 THEN sha256(content) WHEN 1 THEN 'stale' END AS m FROM files UNION ALL SELECT 'x/' || path, 'first', CASE WHEN p_partkey % 2 = 0 THEN 'never' END FROM files)
SELECT w.path, coalesce(f.content IS NULL AND m IS NULL OR m = sha256(f.content), false) AS wrote FROM w LEFT JOIN files f USING (path)""",
)
def compare_and_swap(spark, sf_dir):
    rows = files(spark, sf_dir)
    k = F.col("p_partkey")
    again = rows.select("path", F.concat(F.lit("new "), k.cast("string")).alias("content"), F.when(k % 3 == 0, F.sha2("content", 256)).when(k % 3 == 1, "stale").alias("if_match"))
    first = rows.select(F.concat(F.lit("x/"), "path").alias("path"), F.lit("first").alias("content"), F.when(k % 2 == 0, "never").alias("if_match"))
    writes = again.unionByName(first)
    _, conflicts = vault.compare_and_swap(rows.select("path", "content"), writes)
    return writes.select("path").join(conflicts.select("path", F.lit(False).alias("wrote")), "path", "left").select("path", F.coalesce("wrote", F.lit(True)).alias("wrote"))


@register(
    "section_merge",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '# Notes' || chr(10) || 'new ' || p_name || chr(10) || '# End' || chr(10) || 'z' ELSE '# Other' || chr(10) || 'keep' || chr(10) || chr(10) || '## Notes' || chr(10) || 'new ' || p_name END AS text FROM part",
)
def section_merge(spark, sf_dir):
    old = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("# Notes\nold "), "p_type", F.lit("\n# End\nz"))).otherwise("# Other\nkeep")
    return table(spark, sf_dir, "part").select("p_partkey", vault.merged_section(old, "Notes", F.concat(F.lit("new "), "p_name")).alias("text"))


@register(
    "code_ingest",
    """WITH f AS (SELECT l_orderkey AS repo_id, l_linenumber AS path, md5(CAST(l_partkey AS VARCHAR)) AS hash, l_suppkey FROM lineitem), fresh AS (SELECT * FROM f WHERE path % 3 <> 0)
SELECT 'files' AS kind, count(*) AS n, sum(path) AS total FROM fresh UNION ALL SELECT 'symbols', 2 * count(*), sum(2 * l_suppkey + 1) FROM fresh UNION ALL SELECT 'imports', count(*), sum(path) FROM fresh WHERE l_suppkey % 2 = 0""",
)
def code_ingest(spark, sf_dir):
    hash_ = F.md5(F.col("l_partkey").cast("string"))
    symbols = F.array(F.struct(F.col("l_suppkey").alias("line")), F.struct((F.col("l_suppkey") + 1).alias("line")))
    imports = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.struct(F.col("l_linenumber").alias("module")))).otherwise(F.array().cast("array<struct<module:int>>"))
    file = F.struct(F.col("l_linenumber").alias("relative_path"), hash_.alias("content_hash"), symbols.alias("symbols"), imports.alias("imports"))
    items = table(spark, sf_dir, "lineitem")
    payloads = items.groupBy(F.col("l_orderkey").alias("repo_id")).agg(F.collect_list(file).alias("files"))  # an order has seven lines
    known = items.where("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("repo_id"), F.col("l_linenumber").alias("relative_path"), hash_.alias("content_hash"))
    got = K.ingest(payloads, known)
    total = {"files": "relative_path", "symbols": "line", "imports": "module"}
    out = None
    for name, column in total.items():
        part = got[name].agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.sum(column).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "snapshot_pull",
    """WITH f AS (SELECT o_custkey AS repo_id, o_orderkey AS path FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT repo_id, path, (SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = path) AS symbols FROM f""",
)
def snapshot_pull(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("relative_path"), F.col("o_orderdate").alias("indexed_at"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relative_path"), F.col("l_linenumber").alias("start_line"), F.col("l_partkey").alias("name"), F.lit("k").alias("kind"), F.col("l_suppkey").alias("id"))
    symbols = items.join(orders.select("repo_id", "relative_path"), "relative_path")
    found = K.pull(orders, symbols, F.lit("1998-01-01").cast("timestamp_ntz"))
    return found.select("repo_id", F.col("relative_path").alias("path"), F.array_join(F.transform("symbols", lambda s: s["name"].cast("string")), ",").alias("symbols"))


@register("snapshot_apply", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'pulled' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 4 = 0")
def snapshot_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return K.apply_pull(rows.where("c_custkey % 5 <> 0"), rows.where("c_custkey % 4 = 0").withColumn("seg", F.lit("pulled")), False, ["c_custkey"])


@register(
    "diary_roster",
    """WITH d AS (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'bot' || user_id END AS agent, event_type = 'view' AS silent, ts FROM events) SELECT agent, count(*) AS entries, count(*) FILTER (WHERE silent) AS silent, strftime(max(ts), '%Y-%m-%d') AS last_active FROM d WHERE agent IS NOT NULL GROUP BY agent""",
)
def diary_roster(spark, sf_dir):
    line = F.concat(F.when(F.col("event_type") == "view", "_(silent)_ ").otherwise(""), F.lit("did it"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit(" _via bot"), F.col("user_id").cast("string"), F.lit("_"))).otherwise(""))
    entries = K.diary(table(spark, sf_dir, "events").select(line.alias("line"), F.col("ts").alias("at")))
    silent = entries.groupBy("agent").agg(F.count_if("silent").alias("silent"))
    return K.roster(entries).join(silent, "agent").select("agent", "entries", "silent", F.date_format("last_active", "yyyy-MM-dd").alias("last_active"))


@register(
    "merged_clusters",
    """WITH n AS (SELECT o_custkey AS c, o_orderkey, o_orderpriority AS tag, o_orderstatus AS tag2 FROM orders), t AS (SELECT c, tag FROM (SELECT c, o_orderkey, tag FROM n UNION SELECT c, o_orderkey, tag2 FROM n) GROUP BY c, tag HAVING count(*) >= 2)
SELECT c, max(o_orderkey) AS title, count(*) AS members, (SELECT string_agg(tag, '|' ORDER BY tag) FROM t WHERE t.c = n.c) AS tags FROM n GROUP BY c""",
)
def merged_clusters(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), key.cast("string").alias("path"), key.alias("title"), key.alias("date"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return K.merged_cluster(rows, "c").select("c", "title", "members", F.array_join("tags", "|").alias("tags"))


@register(
    "task_upserts",
    """WITH t AS (SELECT p_name AS title, bool_or(p_size > 25) AS open FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, CASE WHEN t.title IS NULL THEN 'create' WHEN open THEN 'update' ELSE 'skip' END AS action FROM part LEFT JOIN t ON t.title = CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || '!' || p_type END""",
)
def task_upserts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tasks = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, "open").otherwise("closed").alias("status"))
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).otherwise(F.concat("p_name", F.lit("!"), "p_type"))
    asked = part.select(title.alias("title"), "p_partkey")
    return K.task_upsert(tasks, asked.select("title").distinct()).join(asked, "title").select("p_partkey", "action")


@register(
    "tool_search",
    """WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t, (p_size % 10) / 21.0 AS cosine FROM part) SELECT p_partkey AS name, round(greatest(cosine, 0.6 * (contains(t, 'red')::INT + contains(t, 'promo')::INT + contains(t, 'ring')::INT) / 3.0), 6) AS score FROM t ORDER BY round(greatest(cosine, 0.6 * (contains(t, 'red')::INT + contains(t, 'promo')::INT + contains(t, 'ring')::INT) / 3.0), 6) DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0') LIMIT 30""",
)
def tool_search(spark, sf_dir):
    tools = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("description"), ((F.col("p_size") % 10) / 21).alias("cosine"))
    return K.tool_search(tools, ["Red", "promo", "ring"], 30).select(F.col("name").cast("long").alias("name"), F.round("score", 6).alias("score"))


@register(
    "trace_search",
    """WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' for ' || p_type), ' '), lambda w: length(w) >= 3)) AS w, p_size FROM part), o AS (SELECT p_partkey, len(list_intersect(w, ['red', 'ring', 'promo'])) / CAST(len(list_distinct(list_concat(w, ['red', 'ring', 'promo']))) AS DOUBLE) AS overlap, p_size FROM t)
SELECT p_partkey, round(overlap, 6) AS overlap, 'size ' || p_size AS outcome FROM o WHERE overlap >= 0.3 AND p_size >= 10""",
)
def trace_search(spark, sf_dir):
    content = F.concat(F.lit("## Plan\nx\n## Outcome\nsize "), F.col("p_size").cast("string"), F.lit("\n## Notes\ny"))
    expires = F.when(F.col("p_size") < 10, "2023-01-01").when(F.col("p_size") < 30, "2025-01-01")
    traces = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lit("for"), "p_type").alias("goal"), expires.alias("expires"), content.alias("content"))
    return K.trace_search(traces, "a red PROMO ring", 0.3, "2024-01-01").select("p_partkey", F.round("overlap", 6).alias("overlap"), "outcome")


@register(
    "gold_sets",
    """SELECT 'order ' || o_orderkey AS query, string_agg(DISTINCT k, '|' ORDER BY k) AS expected FROM (SELECT o_orderkey, 'o' || o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey, 'p' || l_partkey FROM lineitem) GROUP BY o_orderkey""",
)
def gold_sets(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"))
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return K.gold_set(own, links).select("query", F.array_join("expected", "|").alias("expected"))


@register(
    "point_in_time",
    """WITH r AS (SELECT p_name || ' ' || p_type AS top, 'red' AS expect, CASE WHEN p_size % 2 = 0 THEN 'PROMO' END AS absent FROM part), h AS (SELECT contains(top, expect) AS hit, absent IS NOT NULL AS temporal, coalesce(contains(top, absent), false) AS leak FROM r)
SELECT count(*) AS queries, round(avg(hit::INT), 6) AS recall, round(avg((hit AND NOT leak)::INT) FILTER (WHERE temporal), 6) AS point_in_time, round(avg(leak::INT) FILTER (WHERE temporal), 6) AS stale_leak FROM h""",
)
def point_in_time(spark, sf_dir):
    absent = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("PROMO"))).otherwise(F.array().cast("array<string>"))
    found = K.point_in_time(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("top"), F.array(F.lit("red")).alias("expect"), absent.alias("absent")))
    return found.select("queries", *[F.round(c, 6).alias(c) for c in ("recall", "point_in_time", "stale_leak")])


@register("recent_first", "SELECT p_partkey, d FROM (SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_size END AS d, 'p' || p_partkey AS path FROM part) ORDER BY d DESC NULLS LAST, path LIMIT 20")
def recent_first(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_size")).alias("d"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return K.recent_first(rows, "d").drop("path")


@register(
    "mention_edges",
    """WITH m AS (SELECT l_orderkey, l_partkey, max(l_quantity) / 50 AS confidence FROM lineitem GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, lpad(CAST(l_partkey AS VARCHAR), 9, '0')) AS place FROM m QUALIFY place <= 3)
SELECT lpad(CAST(a.l_partkey AS VARCHAR), 9, '0') AS a, lpad(CAST(b.l_partkey AS VARCHAR), 9, '0') AS b, round(0.6 * max(least(a.confidence, b.confidence)), 4) AS confidence, count(*) AS notes FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2""",
)
def mention_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("name"), (F.col("l_quantity") / 50).alias("confidence"))
    return M.mention_edges(rows, "l_orderkey", 3)


@register(
    "invalidated_facts",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 5 WHEN c_acctbal < 0 THEN 99 END AS valid_to, CASE WHEN c_custkey % 3 <> 0 AND c_acctbal < 0 THEN 99 END AS invalidated_at FROM customer",
)
def invalidated_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, 5).alias("valid_to"))
    return P.invalidated(facts, F.col("c_acctbal") < 0, F.lit(99)).select("c_custkey", "valid_to", "invalidated_at")


@register(
    "extracted_facts",
    "SELECT s_suppkey, 'primary_database' AS predicate, 'plant ' || s_nationkey AS subject, 'db' || (s_suppkey % 9) AS object FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'office_location', 'plant', 'City' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 1",
)
def extracted_facts(spark, sf_dir):
    nation = F.col("s_nationkey").cast("string")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Now the primary database of plant "), nation, F.lit(" is now db"), (F.col("s_suppkey") % 9).cast("string"), F.lit("."))).otherwise(F.concat(F.lit("We heard that the plant office moved to City"), nation, F.lit(".")))
    return P.extract_facts(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text").select("s_suppkey", "predicate", "subject", "object")


@register(
    "entity_links",
    """WITH r AS (SELECT DISTINCT o_custkey AS person, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS org, o_orderstatus AS project FROM orders)
SELECT DISTINCT * FROM (SELECT CAST(person AS VARCHAR) AS subject, 'works_at' AS predicate, org AS object FROM r UNION ALL SELECT CAST(person AS VARCHAR), 'contributes_to', project FROM r UNION ALL SELECT project, 'owned_by', org FROM r) WHERE object IS NOT NULL""",
)
def entity_links(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("person"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("organisation"), F.col("o_orderstatus").alias("project"))
    return K.linked_entities(rows)


@register(
    "daily_promotions",
    """WITH RECURSIVE d AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1), w AS (SELECT 0 AS k, 0.0::DOUBLE AS n UNION ALL SELECT k + 1, n + greatest(0.1, 1 / (1 + log2(greatest(1.0, n)))) FROM w WHERE k < 40) SELECT user_id, round(n, 6) AS score FROM d JOIN w ON k = days""",
)
def daily_promotions(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.to_date("ts"))).alias("days"))
    return days.select("user_id", F.round(L.promoted(F.col("days")), 6).alias("score"))


@register("manual_heat", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN least(16, p_size % 17 + 4) WHEN 1 THEN greatest(0, p_size % 17 - 4) WHEN 2 THEN 0 ELSE p_size % 17 END AS heat FROM part")
def manual_heat(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, ["promote", "cool", "freeze", "archive"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", L.changed(action, F.col("p_size") % 17).alias("heat"))


@register(
    "tag_merge",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda t: CASE t WHEN 'red' THEN 'colour' WHEN 'blue' THEN 'colour' WHEN 'widget' THEN 'thing' ELSE t END))), '|') AS tags FROM part",
)
def tag_merge(spark, sf_dir):
    tags = F.transform(F.split("p_name", " "), lambda t: F.when(t == "red", F.lit("#Red ")).otherwise(t))
    merged = R.merged_tags(tags, {"red": "colour", "blue": "colour", "widget": "thing"})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(merged), "|").alias("tags"))


@register(
    "new_preferences",
    """WITH f AS (SELECT DISTINCT p_type AS kind, 'use the ' || p_name AS phrase FROM part), k AS (SELECT DISTINCT p_type AS kind, 'use the ' || p_name AS phrase FROM part WHERE p_size = 3)
SELECT kind, phrase FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind = f.kind AND levenshtein(k.phrase, f.phrase) / CAST(greatest(length(k.phrase), length(f.phrase)) AS DOUBLE) < 0.3)""",
)
def new_preferences(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.concat(F.lit("use the "), "p_name").alias("phrase"), "p_size")
    known = rows.where("p_size = 3").select("kind", "phrase").distinct()
    return K.new_preferences(rows.select("kind", "phrase"), known).select("kind", "phrase")


@register(
    "conversation_exports",
    """WITH g AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, md5(text) AS user_message, md5(next_text) AS assistant_message FROM g WHERE role = 'user' AND next_role = 'assistant'""",
)
def conversation_exports(spark, sf_dir):
    """Conversations written as three kinds of exports, told apart and read back."""
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    lines = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content")))
    chat = F.struct(F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.col("text").alias("text"))
    # a conversation is one export by its nature
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", lines.alias("line"), chat.alias("chat")))).alias("turns"))
    as_lines = F.array_join(F.transform("turns", lambda t: t["line"]), "\n")
    as_chat = F.to_json(F.struct(F.transform("turns", lambda t: t["chat"]).alias("chat_messages")))
    exports = grouped.select("conv_id", F.when(F.col("conv_id") % 2 == 0, as_lines).otherwise(as_chat).alias("raw"))
    return conversations.exchanges(exports, "conv_id").select("conv_id", "position", F.md5("user_message").alias("user_message"), F.md5("assistant_message").alias("assistant_message"))


@register(
    "context_block",
    f"""WITH {NOTES_SQL}, top AS (SELECT doc_id, '- ' || title || ': ' || substring(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '^ +| +$', '', 'g'), 1, 160) AS line, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM notes QUALIFY n <= 5), b AS (SELECT string_agg(line, chr(10) ORDER BY n) AS b FROM top)
SELECT CASE WHEN length(b) > 1200 THEN substring(b, 1, 1197) || '...' ELSE b END AS block FROM b""",
)
def context_block(spark, sf_dir):
    return plans.context_block(notes(spark, sf_dir), [F.desc("n_chars"), F.col("doc_id")])


@register("symbol_body", "SELECT p_partkey, array_to_string(string_split(p_name || chr(10) || p_type || chr(10) || p_brand || chr(10) || p_size, chr(10))[2:2 + p_size % 3], chr(10)) AS body FROM part")
def symbol_body(spark, sf_dir):
    text = F.concat_ws("\n", "p_name", "p_type", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", code.body(text, F.lit(2), F.lit(2) + F.col("p_size") % 3).alias("body"))


@register(
    "redacted_brief",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'write to [mail] or call [number] on ' || s_nationkey ELSE 'nothing to hide: ' || s_nationkey END AS brief FROM supplier",
)
def redacted_brief(spark, sf_dir):
    nation = F.col("s_nationkey").cast("string")
    told = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("write to a.b+c@d-e.org or call +49 (30) 123-4567 on "), nation)).otherwise(F.concat(F.lit("nothing to hide: "), nation))
    return plans.redacted(table(spark, sf_dir, "supplier").select("s_suppkey", told.alias("brief")), "brief", "guest")


@register(
    "sentence_split",
    "SELECT p_partkey, 2 + (p_size % 2) AS n, 'The ' || p_name || ' arrived.' AS first FROM part",
)
def sentence_split(spark, sf_dir):
    more = F.when(F.col("p_size") % 2 == 1, " It was very late!").otherwise(" Ok.")
    text = F.concat(F.lit("The "), "p_name", F.lit(" arrived. Everybody had been waiting, e.g. for hours."), more)
    found = T.sentences(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(found).alias("n"), F.element_at(found, 1).alias("first"))


@register(
    "exports_as_variants",
    """WITH g AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM (SELECT conv_id, turn, role, CASE WHEN conv_id % 6 = 5 THEN replace(text, chr(10), ' ') ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN 'lines' WHEN 1 THEN 'session' WHEN 2 THEN 'messages' WHEN 3 THEN 'bot' WHEN 4 THEN 'tree' ELSE 'quoted' END AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, md5(text) AS user_message, md5(next_text) AS assistant_message
FROM g WHERE role = 'user' AND next_role = 'assistant'""",
)
def exports_as_variants(spark, sf_dir):
    """Conversations written in six formats, the tree with a branch that says nothing and a loop, told apart and read back."""
    k = F.col("conv_id") % 6
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant') AND trim(text) <> ''")
    rows = rows.withColumn("text", F.when(k == 5, F.translate("text", "\n", " ")).otherwise(F.col("text")))  # a quoted line is a message
    person = F.when(F.col("role") == "user", "human").otherwise("assistant")
    struct = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    line = F.to_json(struct(type=F.col("role"), content=F.array(struct(text=F.col("text")))))
    event = F.to_json(struct(role=F.col("role"), content=F.col("text")))
    chat, bot = F.to_json(struct(sender=person, text=F.col("text"))), F.to_json(F.struct(F.when(F.col("role") == "assistant", "b1").alias("bot_id"), F.when(F.col("role") == "user", "u1").alias("user"), F.col("text").alias("text")))
    said = F.when(k == 0, line).when(k == 1, event).when(k == 2, chat).when(k == 3, bot).when(k == 4, F.to_json(struct(author=F.struct("role"), content=struct(parts=F.array("text"))))).otherwise(F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), "text"))
    # a conversation is one export by its nature
    turns = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda t: t["said"]).alias("s"))
    node = lambda x, i: F.concat(F.lit('"n'), i.cast("string"), F.lit('":{"parent":'), F.when(i == 0, "null").otherwise(F.concat(F.lit('"n'), (i - 1).cast("string"), F.lit('"'))), F.lit(',"children":["n'), (i + 1).cast("string"), F.lit('","side"],"message":'), x, F.lit("}"))
    side = '"side":{"parent":"n0","children":[],"message":{"author":{"role":"system"},"content":{"parts":["hidden"]}}},"x":{"parent":"y","children":["y"]},"y":{"parent":"x","children":["x"],"message":{"author":{"role":"user"},"content":"loop"}}'
    tree = F.concat(F.lit('{"mapping":{' + side + ","), F.array_join(F.transform("s", node), ","), F.lit("}}"))
    listed = F.concat(F.lit("["), F.array_join("s", ","), F.lit("]"))
    raw = F.when(k == 0, F.array_join("s", "\n")).when(k == 1, F.concat(F.lit('{"session_meta":{"id":"s"}}\n{broken\n'), F.array_join("s", "\n"))).when(k == 2, F.concat(F.lit('{"chat_messages":'), listed, F.lit("}"))).when(k == 3, listed).when(k == 4, tree).otherwise(F.array_join("s", "\n"))
    found = exports.exchanges(turns.select("conv_id", raw.alias("raw")), "conv_id")
    return found.select("conv_id", "source", "position", F.md5("user_message").alias("user_message"), F.md5("assistant_message").alias("assistant_message"))
