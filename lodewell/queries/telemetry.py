"""Telemetry queries over the event stream, in batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import telemetry as M
from lodewell.sources.tables import table


@register("heat_histogram", "WITH h AS (SELECT user_id, least(count(*) / 8.0, 16) AS heat FROM events GROUP BY 1) SELECT CAST(least(floor(heat / 4), 3) AS BIGINT) AS bucket, count(*) AS n, round(avg(heat), 4) AS mean FROM h GROUP BY 1")
def heat_histogram(spark, sf_dir):
    heat = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.count("*") / 8.0, F.lit(16.0)).alias("heat"))
    return heat.groupBy(F.least(F.floor(F.col("heat") / 4), F.lit(3)).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("heat"), 4).alias("mean"))


@register(
    "tool_latency_rollup",
    """SELECT coalesce(event_type, 'all') AS tool, count(*) AS calls, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 90) AS errors, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50,
  percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS most FROM events GROUP BY GROUPING SETS ((event_type), ())""",
)
def tool_latency_rollup(spark, sf_dir):
    failed = F.get_json_object("props", "$.k").cast("int") >= 90
    return M.rollup_calls(table(spark, sf_dir, "events").withColumnRenamed("event_type", "tool"), "tool", "value", failed).withColumn("tool", F.coalesce("tool", F.lit("all")))


@register(
    "latency_regression",
    """WITH n AS (SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS most FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS base FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
r AS (SELECT event_type, round(p95 / base, 2) AS growth, round(most / p95, 2) AS tail FROM n JOIN b USING (event_type))
SELECT event_type, growth, tail, CASE WHEN growth > 2.5 OR tail > 3 THEN 'bad' WHEN growth > 1.5 OR tail > 2 THEN 'warn' ELSE 'ok' END AS state FROM r""",
)
def latency_regression(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    p95 = lambda rows: rows.groupBy("event_type").agg(M.nearest_rank("value", 0.95).alias("p95"), F.max("value").alias("most"))
    return M.regression(p95(events.where(F.col("ts") >= half)), p95(events.where(F.col("ts") < half)), "event_type", "p95", "most")


@register(
    "zero_result_stats",
    """SELECT event_type, count(*) AS searches, round(avg(CAST(json_extract(props, '$.k') AS INTEGER)), 4) AS mean_results, round(avg(value), 4) AS mean_latency,
  count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 0) AS zero_results FROM events GROUP BY 1""",
)
def zero_result_stats(spark, sf_dir):
    results = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("searches"), F.round(F.avg(results), 4).alias("mean_results"), F.round(F.avg("value"), 4).alias("mean_latency"), F.count_if(results == 0).alias("zero_results"))


@register(
    "topn_per_group",
    "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 5",
)
def topn_per_group(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal").withColumn("place", place).where("place <= 5")


@register(
    "trailing_60s_rate",
    """WITH r AS (SELECT event_id, event_type, ts, count(*) OVER w AS recent, min(ts) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW))
SELECT event_id, recent, recent <= 5 AS allowed, CASE WHEN recent > 5 THEN strftime(oldest + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') END AS reset_at FROM r""",
)
def trailing_60s_rate(spark, sf_dir):
    rows = M.trailing_rate(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", 3600, 5)
    return rows.select("event_id", "recent", "allowed", F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss").alias("reset_at"))


@register(
    "cumulative_savings",
    """SELECT event_id, user_id, round(sum(greatest(0, 100 - value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS saved FROM events""",
)
def cumulative_savings(spark, sf_dir):
    run = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum(F.greatest(F.lit(0.0), 100 - F.col("value"))).over(run), 2).alias("saved"))


@register(
    "trend_slope",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT n, -row_number() OVER (ORDER BY day DESC) AS i FROM d QUALIFY row_number() OVER (ORDER BY day DESC) <= 12),
f AS (SELECT regr_slope(n, i) AS slope, avg(n) AS mean, arg_min(n, i) AS first, arg_max(n, i) AS last FROM p)
SELECT round(slope, 6) AS slope, CASE WHEN slope > 0.02 * abs(mean) THEN 'up' WHEN slope < -0.02 * abs(mean) THEN 'down' ELSE 'flat' END AS direction, round(100.0 * (last - first) / first, 4) AS change FROM f""",
)
def trend_slope(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return M.trend(daily, "day", "n").select(F.round("slope", 6).alias("slope"), "direction", F.round("change", 4).alias("change"))


@register(
    "minute_buckets",
    """WITH e AS (SELECT date_trunc('hour', max(ts)) AS stop FROM events), g AS (SELECT unnest(generate_series(stop - INTERVAL 14 HOUR, stop, INTERVAL 1 HOUR)) AS bucket FROM e), c AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(bucket, '%Y-%m-%d %H:%M') AS bucket, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bucket)""",
)
def minute_buckets(spark, sf_dir):
    return M.buckets(table(spark, sf_dir, "events"), "ts", "1 hour", "1 HOUR", 15).select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "n")


@register(
    "session_idle_edges",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_idle_edges(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return M.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours").select("user_id", text("start").alias("start"), text("end").alias("stop"), "n")


@register("pooled_p95", "SELECT percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, round(avg(value), 4) AS mean, count(*) AS n FROM events")
def pooled_p95(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(M.nearest_rank("value", 0.95).alias("p95"), F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@register(
    "token_savings",
    """WITH b AS (SELECT event_id, user_id, event_type, value, CASE event_type WHEN 'view' THEN 800 WHEN 'click' THEN 4000 WHEN 'purchase' THEN 8000 WHEN 'signup' THEN 12000 ELSE 0 END AS baseline FROM events)
SELECT event_type, count(*) AS calls, round(sum(greatest(0, baseline - 20 * value)), 2) AS saved, round(avg(greatest(0, baseline - 20 * value)), 2) AS mean FROM b GROUP BY 1""",
)
def token_savings(spark, sf_dir):
    from lodewell.functions.scoring import lookup

    saved = F.greatest(F.lit(0.0), lookup(F.col("event_type"), {"view": 800, "click": 4000, "purchase": 8000, "signup": 12000}, 0) - 20 * F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(saved), 2).alias("saved"), F.round(F.avg(saved), 2).alias("mean"))


@register(
    "session_rollup",
    """WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT user_id, count(*) AS requests, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, arg_max(event_type, (ts, event_id)) AS last_tool FROM events GROUP BY 1)
SELECT l.user_id, requests, last_seen, last_tool, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tools, round(100.0 * requests / (SELECT count(*) FROM events), 4) AS share FROM l JOIN t USING (user_id) GROUP BY ALL""",
)
def session_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    by_tool = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    rolled = by_tool.groupBy("user_id").agg(F.sum("n").alias("requests"), F.max("last").alias("last"), F.sort_array(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))).alias("tools"))
    total = rolled.agg(F.sum("requests").alias("total"))
    return rolled.crossJoin(F.broadcast(total)).select(
        "user_id", "requests", F.date_format("last.ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.col("last.event_type").alias("last_tool"), F.array_join("tools", ",").alias("tools"), F.round(100.0 * F.col("requests") / F.col("total"), 4).alias("share")
    )


@register(
    "metrics_exposition",
    """SELECT '# HELP tool_calls_total Calls by tool' AS line UNION ALL SELECT '# TYPE tool_calls_total counter'
UNION ALL SELECT 'tool_calls_total{tool="' || event_type || '"} ' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) FROM events GROUP BY event_type""",
)
def metrics_exposition(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("value"))
    return M.exposition(counts.select(F.lit("tool_calls_total").alias("name"), F.lit("counter").alias("kind"), F.lit("Calls by tool").alias("help"), F.create_map(F.lit("tool"), "event_type").alias("labels"), "value"))


@register(
    "sampled_series",
    """WITH b AS (SELECT time_bucket(INTERVAL '10 seconds', ts) AS moment, count(*) AS requests, round(avg(value), 6) AS mean FROM events GROUP BY 1)
SELECT strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, requests, mean, (epoch_us(moment) // 10000000) % 6 = 0 AS heavy FROM b ORDER BY b.moment DESC LIMIT 360""",
)
def sampled_series(spark, sf_dir):
    rows = M.sampled(table(spark, sf_dir, "events"), "ts", "value")
    return rows.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("moment"), "requests", "mean", "heavy")


@register(
    "derived_signals",
    """WITH t AS (SELECT event_type, count(*) AS calls, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, avg(value) AS mean FROM events GROUP BY 1)
SELECT round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type <> 'view'), 1) AS error_pct, (SELECT round(sum(calls * p95 / mean) / sum(calls), 2) FROM t) AS tail_ratio,
  (SELECT round(max(n) / sum(n), 4) FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)) AS top_session_share FROM events""",
)
def derived_signals(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tools = events.groupBy("event_type").agg(F.count("*").alias("calls"), M.nearest_rank("value", 0.95).alias("p95"), F.avg("value").alias("mean"))
    kind = F.when(F.col("event_type") == "view", "health").otherwise("tool")
    return M.derived_signals(tools, events.select(kind.alias("kind"), F.col("user_id").alias("session"), (F.col("event_type") == "error").alias("failed")))


@register(
    "arm_report",
    """SELECT event_type AS arm, count(*) AS queries, round(avg(CAST(value > 20 AS INTEGER)), 4) AS recall, round(avg(1.0 / (1 + user_id % 7)), 4) AS mrr, round(avg(value), 4) AS mean_latency, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY value), 4) AS p95_latency FROM events GROUP BY 1""",
)
def arm_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") > 20).cast("double").alias("recall"), (1.0 / (1 + F.col("user_id") % 7)).alias("reciprocal_rank"), F.col("value").alias("latency"))
    return M.arm_report(rows, "arm")


@register(
    "due_jobs",
    """WITH j AS (SELECT user_id AS job, max(ts) AS last_run, CAST(user_id % 24 AS INTEGER) AS hour, user_id % 2 = 0 AS daily, user_id % 9 = 0 AS running FROM events GROUP BY user_id), n AS (
  SELECT *, CASE WHEN daily THEN CASE WHEN date_trunc('day', last_run) + to_hours(hour) > last_run THEN date_trunc('day', last_run) + to_hours(hour) ELSE date_trunc('day', last_run) + to_hours(hour + 24) END ELSE last_run + INTERVAL 6 HOUR END AS next_run FROM j)
SELECT job, strftime(next_run, '%Y-%m-%d %H:%M:%S') AS next_run, CASE WHEN next_run > TIMESTAMP '2024-01-30 12:00:00' THEN 'wait' WHEN running THEN 'skip' ELSE 'run' END AS action FROM n""",
)
def due_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("last_run"))
    jobs = jobs.withColumns({"hour": (F.col("job") % 24).cast("int"), "minute": F.lit(0), "daily": F.col("job") % 2 == 0, "every": F.lit(6 * 3600), "running": F.col("job") % 9 == 0})
    return M.due_jobs(jobs, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("job", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"), "action")


@register(
    "floored_counters",
    """WITH e AS (SELECT user_id AS tool, ts AS moment, event_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * (1 + event_id % 3) AS calls, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * (event_id % 40) AS tokens, event_type = 'error' AS pushed FROM events)
SELECT tool, CAST(list_reduce(list_prepend(0, list(calls ORDER BY moment, event_id)), lambda s, c: greatest(0, s + c)) AS BIGINT) AS calls, CAST(list_reduce(list_prepend(0, list(tokens ORDER BY moment, event_id)), lambda s, c: greatest(0, s + c)) AS BIGINT) AS tokens_saved,
  strftime(max(moment) FILTER (WHERE pushed), '%Y-%m-%d %H:%M:%S') AS last_pushed_at FROM e GROUP BY tool""",
)
def floored_counters(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("tool"), F.col("ts").alias("at"), "event_id", (1 + i % 3).alias("calls"), (i % 40).alias("tokens_saved"), (F.col("event_type") == "error").alias("pushed"))
    return M.savings(rows, order=("event_id",)).withColumn("last_pushed_at", F.date_format("last_pushed_at", "yyyy-MM-dd HH:mm:ss"))
