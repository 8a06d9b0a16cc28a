"""Lifecycle queries: documents are notes, the event stream is their access log (user_id names the note)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.functions import scoring as S
from lodewell.functions import text as T
from lodewell.operators import lifecycle as L
from lodewell.sources.tables import NOTES_SQL, notes, table

_CATEGORIES = ["fact", "preference", "decision", "insight", "observation", "reflection", "plan", "conversation"]
_USE = f"""{NOTES_SQL}, u AS (
  SELECT doc_id, n_chars, title, content, tags, doc_id % 40 AS days_updated, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') AS days, count(event_id) AS accesses, count(DISTINCT event_type) AS inbound,
         ['critical', 'high', 'medium', 'low'][CAST(doc_id % 4 AS INTEGER) + 1] AS importance, {_CATEGORIES}[CAST(doc_id % 8 AS INTEGER) + 1] AS category, max(ts) AS last_access
  FROM notes LEFT JOIN events ON user_id = doc_id GROUP BY ALL), h AS (
  SELECT *, (CASE WHEN days_updated <= 1 THEN 4 WHEN days_updated <= 3 THEN 3 WHEN days_updated <= 7 THEN 2 WHEN days_updated <= 30 THEN 1 ELSE 0 END
    + CASE WHEN days <= 1 THEN 3 WHEN days <= 3 THEN 2 WHEN days <= 7 THEN 1 ELSE 0 END + CASE WHEN accesses >= 20 THEN 3 WHEN accesses >= 10 THEN 2 WHEN accesses >= 3 THEN 1 ELSE 0 END
    + CASE WHEN inbound >= 10 THEN 3 WHEN inbound >= 5 THEN 2 WHEN inbound >= 1 THEN 1 ELSE 0 END) AS heat_score FROM u), t AS (
  SELECT *, CASE WHEN heat_score >= 10 THEN 'hot' WHEN heat_score >= 4 THEN 'warm' ELSE 'cold' END AS temperature FROM h)"""
_WORTH = "CASE category WHEN 'fact' THEN 2.0 WHEN 'preference' THEN 1.8 WHEN 'decision' THEN 1.5 WHEN 'insight' THEN 1.2 WHEN 'observation' THEN 1.0 WHEN 'reflection' THEN 0.8 WHEN 'plan' THEN 0.5 ELSE 0.3 END"
_ROI = f"600 * exp(-0.05 * (days + 60)) * (1 + 0.1 * least(accesses, 50)) * 3 * {_WORTH} - (ceil(n_chars / 4.0) + 50)"
_RATE = """CASE category WHEN 'fact' THEN 0.25 WHEN 'preference' THEN 0.25 WHEN 'decision' THEN 0.5 WHEN 'insight' THEN 1 / 1.5 WHEN 'plan' THEN 1 / 0.7 WHEN 'conversation' THEN 2.0 ELSE 1.0 END
  * CASE importance WHEN 'critical' THEN 0.5 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 1.0 ELSE 1.5 END"""


def used(spark, sf_dir):
    """Notes with their use until 2024-01-31; the access log is summed up before it is joined."""
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("accesses"), F.countDistinct("event_type").alias("inbound"), F.max("ts").alias("last_access"))
    importance = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (F.col("doc_id") % 4 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = notes(spark, sf_dir).drop("heat").join(log, "doc_id", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0))).withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    rows = rows.withColumn("importance", importance).withColumn("category", category).withColumn("days_updated", F.col("doc_id") % 40).withColumn("days", F.datediff(F.lit("2024-01-31").cast("date"), F.col("last_access").cast("date")))
    rows = rows.withColumn("heat_score", S.heat_score(F.col("days_updated"), F.col("days"), F.col("accesses"), F.col("inbound")))
    return rows.withColumn("temperature", S.temperature(F.col("heat_score")))


@register("heat_score", f"WITH {_USE} SELECT doc_id, heat_score, temperature FROM t")
def heat_score(spark, sf_dir):
    return used(spark, sf_dir).select("doc_id", "heat_score", "temperature")


@register("heat_decay", f"WITH {_USE} SELECT doc_id, round(greatest(0, heat_score - CASE WHEN days > 30 THEN 2 WHEN days > 7 THEN 1 ELSE 0 END * {_RATE}), 4) AS decayed FROM t")
def heat_decay(spark, sf_dir):
    left = S.decayed(F.col("heat_score"), F.coalesce("days", F.lit(0)), F.col("category"), F.col("importance"))
    return used(spark, sf_dir).select("doc_id", F.round(left, 4).alias("decayed"))


@register("roi_demotion", f"WITH {_USE} SELECT doc_id, round({_ROI}, 2) AS roi FROM t WHERE days IS NOT NULL AND {_ROI} < 0 ORDER BY roi, doc_id LIMIT 100")
def roi_demotion(spark, sf_dir):
    """As of sixty days later."""
    roi = S.roi(F.col("days") + 60, F.col("accesses"), F.col("category"), F.col("n_chars"))
    rows = used(spark, sf_dir).where("days IS NOT NULL").withColumn("roi", roi).where("roi < 0")
    return rows.select("doc_id", F.round("roi", 2).alias("roi")).orderBy("roi", "doc_id").limit(100)


@register(
    "archive_candidates",
    f"WITH {_USE}, p AS (SELECT doc_id, CASE WHEN coalesce(temperature = 'cold' AND date_diff('day', CAST(last_access AS DATE), DATE '2024-06-01') > 90, false) THEN CASE WHEN doc_id % 3 = 0 OR list_contains(tags, 'src4') THEN 'archive' ELSE 'skip' END ELSE 'keep' END AS plan FROM t) SELECT plan, count(*) AS n, sum(doc_id) AS ids FROM p GROUP BY 1",
)
def archive_candidates(spark, sf_dir):
    rows = used(spark, sf_dir).withColumn("merged", F.col("doc_id") % 3 == 0).withColumn("templated", F.array_contains("tags", "src4"))
    return L.archive_plan(rows, F.lit("2024-06-01").cast("date")).groupBy("plan").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@register("promote_candidates", f"WITH {_USE} SELECT doc_id, accesses FROM t WHERE accesses >= 5 AND days <= 32 ORDER BY accesses DESC, doc_id LIMIT 50")
def promote_candidates(spark, sf_dir):
    return used(spark, sf_dir).where("accesses >= 5 AND days <= 32").select("doc_id", "accesses").orderBy(F.desc("accesses"), "doc_id").limit(50)


@register(
    "vault_health",
    f"""WITH {_USE}, b AS (SELECT count(*) AS notes, avg(CAST(len(tags) > 0 AS INTEGER)) AS tag_coverage, avg(inbound) AS link_density, avg(CAST(inbound = 0 AS INTEGER)) AS orphan_ratio, avg(heat_score) AS avg_heat,
  avg(CAST(temperature = 'hot' AS INTEGER)) AS hot, avg(CAST(temperature = 'warm' AS INTEGER)) AS warm, avg(CAST(temperature = 'cold' AS INTEGER)) AS cold FROM t),
s AS (SELECT *, floor(least(100, greatest(0, 100 * (0.25 * tag_coverage + 0.25 * least(1, link_density / 3) + 0.25 * (1 - orphan_ratio) + 0.15 * least(1, avg_heat / 8) + 0.1 * greatest(0, 1 - 2 * greatest(0, hot - 0.4) - 2 * greatest(0, cold - 0.8))))) + 0.5) AS raw FROM b)
SELECT notes, round(tag_coverage, 4) AS tag_coverage, round(link_density, 4) AS link_density, round(orphan_ratio, 4) AS orphan_ratio, round(avg_heat, 4) AS avg_heat, round(hot, 4) AS hot, round(warm, 4) AS warm, round(cold, 4) AS cold,
  CAST(raw AS BIGINT) AS score, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'A-' WHEN raw >= 70 THEN 'B+' WHEN raw >= 60 THEN 'B' WHEN raw >= 50 THEN 'C+' WHEN raw >= 40 THEN 'C' WHEN raw >= 30 THEN 'D' ELSE 'F' END AS grade FROM s""",
)
def vault_health(spark, sf_dir):
    rows = used(spark, sf_dir).withColumn("links", F.col("inbound")).withColumn("heat", F.col("heat_score"))
    found = L.health(rows)
    return found.select("notes", *[F.round(c, 4).alias(c) for c in ("tag_coverage", "link_density", "orphan_ratio", "avg_heat", "hot", "warm", "cold")], "score", "grade")


_RULES = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in L.CATEGORY_RULES)


@register(
    "category_inference",
    f"""WITH c AS (SELECT role, CASE {_RULES} END AS word FROM conversations)
SELECT CASE WHEN role = 'system' THEN 'plan' ELSE coalesce(word, 'general') END AS category, CASE WHEN role = 'system' THEN 'type' WHEN word IS NOT NULL THEN 'keywords' ELSE 'default' END AS source, count(*) AS n FROM c GROUP BY 1, 2""",
)
def category_inference(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "task")
    name, source = L.category(F.lit(None).cast("string"), kind, F.lit(""), F.col("text"))
    return rows.groupBy(name.alias("category"), source.alias("source")).agg(F.count("*").alias("n"))


@register(
    "hebbian_decay",
    """WITH p AS (SELECT user_id AS node, event_type AS other, count(*) AS w, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') AS days FROM events GROUP BY 1, 2)
SELECT node, other, round(w * pow(0.98, days), 6) AS w FROM p WHERE w * pow(0.98, days) >= 0.05""",
)
def hebbian_decay(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("other")).agg(F.count("*").alias("n"), F.datediff(F.lit("2024-03-01").cast("date"), F.max("ts").cast("date")).alias("days"))
    kept = F.col("n") * F.pow(F.lit(0.98), F.when(F.col("days") >= 1, F.col("days")).otherwise(0))
    return pairs.withColumn("w", kept).where("w >= 0.05").select("node", "other", F.round("w", 6).alias("w"))


@register(
    "keep_last_fold_week",
    """WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
SELECT user_id, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week, count(*) AS n, min(event_id) AS first FROM r WHERE place > 5 GROUP BY 1, 2""",
)
def keep_last_fold_week(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("key"), "ts")
    return L.keep_last(rows, "user_id", "ts", 5).groupBy("user_id", "week").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@register(
    "token_budget_cut",
    """WITH r AS (SELECT lang, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents)
SELECT lang, doc_id, CAST(used AS BIGINT) AS used, length(substring(text, 1, CAST(3600 - used AS INTEGER))) AS kept_chars FROM r WHERE used < 3600""",
)
def token_budget_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text", "n_chars")
    cut = L.budget_cut(docs, "lang", [F.col("n_chars"), F.col("doc_id")], "text", 900)
    return cut.select("lang", "doc_id", F.col("used").cast("long").alias("used"), F.length("kept").cast("long").alias("kept_chars"))


@register(
    "staged_context",
    f"WITH {NOTES_SQL} SELECT collection, doc_id, heat, substring(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 80) AS snippet, row_number() OVER (PARTITION BY collection ORDER BY heat DESC, doc_id) AS place FROM notes QUALIFY row_number() OVER (PARTITION BY collection ORDER BY heat DESC, doc_id) <= 5",
)
def staged_context(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("heat"), "doc_id"))
    top = notes(spark, sf_dir).withColumn("place", place).where("place <= 5")
    return top.select("collection", "doc_id", "heat", T.snippet(F.col("content"), 80).alias("snippet"), "place")


@register(
    "dream_cycle_report",
    f"""WITH {_USE}, d AS (SELECT *, coalesce(days, 365) AS age, greatest(0, heat_score - CASE WHEN coalesce(days, 365) > 30 THEN 2 WHEN coalesce(days, 365) > 7 THEN 1 ELSE 0 END * {_RATE}) AS kept FROM t)
SELECT count(*) AS notes, count(*) FILTER (WHERE kept < 4) AS cold, count(*) FILTER (WHERE kept < heat_score) AS decayed, count(*) FILTER (WHERE age >= 30 AND 600 * exp(-0.05 * age) * (1 + 0.1 * least(accesses, 50)) * 3 * {_WORTH} - (ceil(n_chars / 4.0) + 50) < 0) AS demote,
  count(*) FILTER (WHERE accesses >= 5 AND age <= 30) AS promote FROM d""",
)
def dream_cycle_report(spark, sf_dir):
    return L.dream_report(used(spark, sf_dir).withColumn("heat", F.col("heat_score")).withColumn("length", F.col("n_chars")).withColumn("days", F.coalesce("days", F.lit(365))))


@register("theme_detection", "SELECT least(lang, source) || '+' || greatest(lang, source) AS theme, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) >= 3")
def theme_detection(spark, sf_dir):
    return L.themes(notes(spark, sf_dir).select(F.col("doc_id").alias("key"), "tags"))


@register("halls", f"WITH {_USE} SELECT category, count(*) AS n FROM t GROUP BY category")
def halls(spark, sf_dir):
    return used(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@register(
    "activity_summary",
    f"""WITH {_USE} SELECT count(*) AS notes, count(*) FILTER (WHERE temperature = 'hot') AS hot, count(*) FILTER (WHERE temperature = 'warm') AS warm, count(*) FILTER (WHERE temperature = 'cold') AS cold,
  count(*) FILTER (WHERE days_updated <= 7) AS created, count(*) FILTER (WHERE days <= 7) AS accessed FROM t""",
)
def activity_summary(spark, sf_dir):
    day = F.lit("2024-01-31").cast("date")
    rows = used(spark, sf_dir).withColumn("created", F.date_sub(day, F.col("days_updated").cast("int"))).withColumn("accessed", F.col("last_access").cast("date"))
    return L.activity(rows, day, 7)


@register(
    "dominant_temperature",
    f"""WITH {_USE}, c AS (SELECT category, count(*) FILTER (WHERE temperature = 'hot') AS hot, count(*) FILTER (WHERE temperature = 'warm') AS warm, count(*) FILTER (WHERE temperature NOT IN ('hot', 'warm')) AS cold FROM t GROUP BY category)
SELECT category, CASE WHEN hot >= warm AND hot >= cold THEN 'hot' WHEN warm >= cold THEN 'warm' ELSE 'cold' END AS temperature FROM c""",
)
def dominant_temperature(spark, sf_dir):
    return L.dominant_temperature(used(spark, sf_dir), "category")


@register("coldest_orphans", f"WITH {_USE} SELECT doc_id, heat_score AS heat, days_updated AS age_days FROM t WHERE inbound = 0 ORDER BY heat_score, days_updated DESC, CAST(doc_id AS VARCHAR) LIMIT 40")
def coldest_orphans(spark, sf_dir):
    rows = used(spark, sf_dir).where("inbound = 0").select("doc_id", F.col("heat_score").alias("heat"), F.col("days_updated").alias("age_days"), F.col("doc_id").cast("string").alias("path"))
    return L.coldest_first(rows, 40).drop("path")


@register("orphans_by_temperature", f"WITH {_USE} SELECT doc_id, temperature, heat_score AS heat FROM t WHERE inbound < 3 ORDER BY CASE temperature WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, heat_score DESC, CAST(doc_id AS VARCHAR) LIMIT 60")
def orphans_by_temperature(spark, sf_dir):
    rows = used(spark, sf_dir).where("inbound < 3").select("doc_id", "temperature", F.col("heat_score").alias("heat"), F.col("doc_id").cast("string").alias("path"))
    return L.by_temperature(rows, 60).drop("path")


@register(
    "promotion_history",
    """WITH h AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_append(l, -1)[greatest(1, len(l) - 3):], ',') AS history FROM h""",
)
def promotion_history(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    # of the entries before, only four can stay: no more are gathered
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    last = rows.withColumn("place", place).where("place <= 4").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), F.col("o_orderkey").cast("string").alias("key")))), lambda s: s["key"]).alias("entries"))
    return last.select("o_custkey", F.array_join(L.history(F.col("entries"), F.lit("-1")), ",").alias("history"))


@register(
    "open_task_protection",
    "SELECT DISTINCT l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_linenumber = 1",
)
def open_task_protection(spark, sf_dir):
    """Parts whose first line of an order is still open; a part is a note, an order a task."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    return L.tied_to_open_tasks(parts, items.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")), tasks).select(F.col("path").alias("part"))
