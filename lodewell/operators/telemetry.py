"""Telemetry: roll-ups, sliding windows, buckets, trends, sessions of tool events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: str, share: float) -> Column:
    """The value at place ceil(share * n): an element of the data, exactly."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def rollup_calls(events: DataFrame, tool: str, value: str, failed: Column) -> DataFrame:
    """Per tool and over all: calls, errors, nearest-rank p50 and p95, the greatest value."""
    return events.withColumn("failed", failed).rollup(tool).agg(
        F.count("*").alias("calls"), F.count_if("failed").alias("errors"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95"), F.max(value).alias("most")
    )


def trailing_rate(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Events of the key in the `seconds` up to each one, whether it is within the limit, and when the window frees up."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = events.withColumn("_at", micros)
    n, oldest = F.count("*").over(frame), F.min("_at").over(frame)
    return out.select("*", n.alias("recent"), oldest.alias("_oldest")).withColumn("allowed", F.col("recent") <= most).withColumn("reset_at", F.when(~F.col("allowed"), F.timestamp_micros(F.col("_oldest") + seconds * 1_000_000))).drop("_at", "_oldest")


def buckets(events: DataFrame, ts: str, width: str, step: str, last: int) -> DataFrame:
    """Counts of the last `last` buckets up to the latest event, empty ones too."""
    counts = events.groupBy(F.window(ts, width).start.alias("bucket")).agg(F.count("*").alias("n"))
    ends = events.agg(F.max(ts).alias("end")).select(F.window("end", width).start.alias("end"))
    grid = ends.select(F.explode(F.expr(f"sequence(end - {last - 1} * INTERVAL {step}, end, INTERVAL {step})")).alias("bucket"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def trend(series: DataFrame, at: str, value: str, last: int = 12, dull: float = 0.02) -> DataFrame:
    """Direction of the least-squares line through the last points, and the change from first to last in per cent."""
    order = Window.orderBy(F.desc(at))
    points = series.orderBy(F.desc(at)).limit(last).withColumn("i", (-F.row_number().over(order)).cast("double"))
    fit = points.agg(F.regr_slope(value, "i").alias("slope"), F.avg(value).alias("mean"), F.min_by(value, "i").alias("first"), F.max_by(value, "i").alias("last"))
    direction = F.when(F.col("slope") > dull * F.abs("mean"), "up").when(F.col("slope") < -dull * F.abs("mean"), "down").otherwise("flat")
    return fit.select("slope", direction.alias("direction"), (100 * (F.col("last") - F.col("first")) / F.col("first")).alias("change"))


#: Up to where a ratio is fine, and up to where it is a warning.
GROWTH, TAIL = (1.5, 2.5), (2.0, 3.0)


def regression(now: DataFrame, baseline: DataFrame, key: str, p95: str, most: str) -> DataFrame:
    """State of each tool against its baseline: the worse of the p95's growth (0 without a baseline) and of the tail's length."""
    both = now.join(baseline.select(key, F.col(p95).alias("base")), key, "left")
    growth = F.coalesce(F.round(F.col(p95) / F.when(F.col("base") > 0, F.col("base")), 2), F.lit(0.0))
    tail = F.coalesce(F.round(F.col(most) / F.when(F.col(p95) > 0, F.col(p95)), 2), F.lit(0.0))
    bad = (growth > GROWTH[1]) | (tail > TAIL[1])
    warn = (growth > GROWTH[0]) | (tail > TAIL[0])
    return both.select(key, growth.alias("growth"), tail.alias("tail"), F.when(bad, "bad").when(warn, "warn").otherwise("ok").alias("state"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions that a quiet gap ends: start, end and number of events."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def exposition(metrics: DataFrame) -> DataFrame:
    """Lines of the plain text format of counters and gauges, from rows (name, kind, help, labels map, value)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    sample = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    head = metrics.select("name", "kind", "help").distinct().select("name", F.lit(0).alias("part"), F.explode(F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"))).alias("line"))
    return head.unionByName(metrics.select("name", F.lit(1).alias("part"), sample.alias("line"))).orderBy("name", "part", "line").select("line")


def sampled(events: DataFrame, ts: str, value: str, width: str = "10 seconds", last: int = 360) -> DataFrame:
    """(at, requests, mean, heavy): one row for each window that had events, the last `last` of them; every sixth window is marked for heavier samples."""
    rows = events.groupBy(F.window(ts, width).start.alias("at")).agg(F.count("*").alias("requests"), F.round(F.avg(value), 6).alias("mean"))
    step = F.expr(f"cast(unix_micros(timestamp '1970-01-01 00:00:00 UTC' + INTERVAL {width}) AS long)")
    number = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / step)
    return rows.orderBy(F.desc("at")).limit(last).withColumn("heavy", number % 6 == 0)


def derived_signals(tools: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: errors in per cent of requests that are no health checks, p95 by mean weighted by calls, and the busiest session's share.

    `tools` has calls, p95 and mean of each tool, `requests` kind, session and failed.
    """
    tail = tools.where("mean > 0").agg(F.round(F.sum(F.col("calls") * F.col("p95") / F.col("mean")) / F.sum("calls"), 2).alias("tail_ratio"))
    busy = F.col("kind") != "health"
    errors = requests.agg(F.round(100 * F.count_if(F.col("failed")) / F.when(F.count_if(busy) > 0, F.count_if(busy)), 1).alias("error_pct"))
    top = requests.groupBy("session").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 4).alias("top_session_share"))
    # each side is one row
    return errors.crossJoin(tail).crossJoin(top)


def arm_report(results: DataFrame, arm: str) -> DataFrame:
    """(arm, queries, recall, mrr, mean and p95 latency) from a row for each query; the p95 by nearest rank."""
    return results.groupBy(arm).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.round(nearest_rank("latency", 0.95), 4).alias("p95_latency"))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (last_run, daily, hour, minute, every: seconds, running) with next_run and action: wait, run, or skip what is due but still runs."""
    clock = F.date_trunc("day", "last_run") + F.make_interval(hours=F.col("hour"), mins=F.col("minute"))
    daily = F.when(clock > F.col("last_run"), clock).otherwise(clock + F.make_interval(days=F.lit(1)))
    after = F.when(F.col("daily"), daily).otherwise(F.col("last_run") + F.make_interval(secs=F.col("every")))
    return jobs.withColumn("next_run", after).withColumn("action", F.when(F.col("next_run") > now, "wait").when(F.col("running"), "skip").otherwise("run"))


def debounced(events: DataFrame, key: str, ts: str, quiet: str = "5 seconds") -> DataFrame:
    """(key, flush_at, changes): one flush for each run of changes, when it has been quiet for so long; for batches and streams alike."""
    return events.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("changes")).select(key, F.col("w.end").alias("flush_at"), "changes")


def unexpired(cache: DataFrame, at: str, ttl_seconds: int, now: Column) -> DataFrame:
    """Entries of a cache that are younger than their time to live."""
    return cache.where(F.col(at) + F.make_interval(secs=F.lit(ttl_seconds)) > now)


def floored(events: DataFrame, key: str, at: str, change: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """events with `value`: the running sum of `change` for each key, in order of `at` and `order`, that never falls below 0.

    It is the prefix sum less its least value so far, where that is negative. A key's events are cut
    into buckets of time (days unless said otherwise): sums and least prefixes of buckets, a row each,
    carry over what lies before, so a hot key is as many groups as it has buckets. Null changes count 0.
    """
    bucket = F.to_date(at) if bucket is None else bucket
    rows = events.withColumn("_bucket", bucket).withColumn("_change", F.coalesce(change, F.lit(0)))
    within = Window.partitionBy(key, "_bucket").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum("_change").over(within)).withColumn("_least", F.min("_sum").over(within))
    each = summed.groupBy(key, "_bucket").agg(F.max_by("_sum", F.struct(at, *order)).alias("_total"), F.min("_least").alias("_low"))
    before = Window.partitionBy(key).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    carried = carried.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_low")).over(before), F.lit(0)))).select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), "_base", "_floor")
    both = summed.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    value = F.col("_base") + F.col("_sum") - F.least(F.lit(0), F.col("_floor"), F.col("_base") + F.col("_least"))
    return both.select(*events.columns, value.alias("value"))


def savings(events: DataFrame, tool: str = "tool", at: str = "at", order: tuple[str, ...] = ()) -> DataFrame:
    """(tool, calls, tokens_saved, last_pushed_at) from bumps and pushes (tool, at, calls, tokens_saved, pushed): a push takes back what it sent, and no counter falls below 0."""
    sign = F.when(F.coalesce("pushed", F.lit(False)), -1).otherwise(1)
    signed = events.withColumn("_calls", sign * F.col("calls")).withColumn("_tokens", sign * F.col("tokens_saved"))
    both = floored(floored(signed, tool, at, "_calls", list(order)).withColumnRenamed("value", "_now_calls"), tool, at, "_tokens", list(order))
    last = lambda c: F.max_by(c, F.struct(at, *order))
    return both.groupBy(tool).agg(last("_now_calls").alias("calls"), last("value").alias("tokens_saved"), F.max(F.when(F.coalesce("pushed", F.lit(False)), F.col(at))).alias("last_pushed_at"))
