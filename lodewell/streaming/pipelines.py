"""Structured Streaming forms of the polling, windowing and stateful behaviour."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def poll_files(spark: SparkSession, folder: str, schema: str, most: int = 100) -> DataFrame:
    """A stream of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(folder)


def sampled(events: DataFrame, ts: str, value: str, width: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """Counts and means of tumbling windows; rows later than `late` are not counted."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def sliding_rate(events: DataFrame, key: str, ts: str, width: str = "60 seconds", step: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, width, step)).agg(F.count("*").alias("n")).select(key, F.col("window.end").alias("until"), "n")


def idle_edges(events: DataFrame, key: str, ts: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """One row for each session that a quiet gap has ended."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def co_recall_state(pairs: DataFrame, cap: int = 32, rate: float = 0.98) -> DataFrame:
    """(node, neighbour, w) of a graph kept as state by node: each pair adds 1, weights decay by `rate` a day, the `cap` strongest stay.

    `pairs` has node, neighbour and ts, both directions. A node's state has `cap` entries at most.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, weights, at = state.get if state.exists else ([], [], 0.0)
        held = dict(zip(names, weights))
        for batch in batches:
            for name, ts in sorted(zip(batch["neighbour"], batch["ts"]), key=lambda r: r[1]):
                now = ts.timestamp()
                if at and now - at >= 86_400:
                    factor = rate ** ((now - at) / 86_400)
                    held = {k: w * factor for k, w in held.items() if w * factor >= 0.05}
                at = max(at, now)
                held[name] = held.get(name, 0.0) + 1.0
        best = sorted(held.items(), key=lambda r: (-r[1], r[0]))[:cap]
        state.update(([k for k, _ in best], [w for _, w in best], at))
        yield pd.DataFrame({"node": key[0], "neighbour": [k for k, _ in best], "w": [w for _, w in best]})

    return pairs.groupBy("node").applyInPandasWithState(update, "node string, neighbour string, w double", "names array<string>, weights array<double>, at double", "update", GroupStateTimeout.NoTimeout)


#: Seconds of a day, the share of a weight that is left after one, the weight below which an edge is forgotten, and edges that a node keeps.
DAY, RATE, FORGOTTEN, KEPT = 86_400.0, 0.98, 0.05, 32
EDGES = "node string, neighbour string, w double, at timestamp"


class _CoRecall(StatefulProcessor):
    """A node's edges as a map from neighbour to (weight, second), and a timer for the first edge that will be forgotten."""

    def __init__(self, cap: int, rate: float, least: float):
        self.cap, self.rate, self.least = cap, rate, least

    def init(self, handle) -> None:
        self.handle, self.edges = handle, handle.getMapState("edges", "neighbour string", "w double, at double")

    def _left(self, w: float, seconds: float) -> float:
        return w * self.rate ** (seconds / DAY)

    def _pruned(self, now: float) -> tuple[list, list]:
        """Edges that stay, with their weights now, and those that go: forgotten, or beyond the strongest."""
        held = [(k[0], self._left(w, now - at)) for k, (w, at) in self.edges.iterator()]
        strong = sorted((x for x in held if x[1] >= self.least), key=lambda x: (-x[1], x[0]))
        gone = [k for k, w in held if w < self.least] + [k for k, _ in strong[self.cap :]]
        for k in gone:
            self.edges.removeKey((k,))
        if strong and self.rate < 1:
            seconds = math.log(strong[: self.cap][-1][1] / self.least) / -math.log(self.rate) * DAY
            self.handle.registerTimer(int((now + seconds) * 1000) + 1)
        return strong[: self.cap], gone

    def _told(self, node: str, kept: list, gone: list, now: float) -> pd.DataFrame:
        rows = [(node, k, w) for k, w in kept] + [(node, k, 0.0) for k in gone]
        out = pd.DataFrame(rows, columns=["node", "neighbour", "w"]).astype({"node": object, "neighbour": object, "w": float})
        out["at"] = pd.Series([pd.Timestamp(round(now * 1e6), unit="us")] * len(out), dtype="datetime64[us]")
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, touched = 0.0, set()
        for batch in rows:
            for name, ts in zip(batch["neighbour"], batch["ts"]):
                t = ts.timestamp()
                w, at = self.edges.getValue((name,)) if self.edges.containsKey((name,)) else (0.0, t)
                then = max(at, t)  # a late row has decayed since
                self.edges.updateValue((name,), (self._left(w, then - at) + self._left(1.0, then - t), then))
                touched.add(name)
        now = max((at for _, (_, at) in self.edges.iterator()), default=0.0)
        kept, gone = self._pruned(now)
        yield self._told(key[0], [x for x in kept if x[0] in touched], gone, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        _, gone = self._pruned(now)
        yield self._told(key[0], [], gone, now)

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Has streams keep state in RocksDB, which state by key with timers needs; a session setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def co_recall_graph(pairs: DataFrame, late: str = "1 day", cap: int = KEPT, rate: float = RATE, least: float = FORGOTTEN) -> DataFrame:
    """(node, neighbour, w, at) as updates of a graph that is kept as state: each pair adds 1, and what has been added decays by `rate` a day.

    `pairs` (node, neighbour, ts) holds both directions. State is a map by neighbour, of which a pair
    reads and writes its own entry; only pruning looks at a node's `cap` entries. Weights are of the
    node's latest pair, so the order of rows plays no part, nor do rows that come `late` at most; later
    ones are not counted. An edge that falls below `least` is told with weight 0, by a timer if nothing
    else comes, and so is one that stronger ones push out. Needs `keyed_state`.
    """
    rows = pairs.where("node IS NOT NULL AND neighbour IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("node").transformWithStateInPandas(_CoRecall(cap, rate, least), EDGES, "Update", "EventTime")


def co_recall_until(pairs: DataFrame, cap: int = KEPT, rate: float = RATE, least: float = FORGOTTEN) -> DataFrame:
    """The batch form: (node, neighbour, w) at each node's latest pair, from all pairs at once."""
    last = pairs.groupBy("node").agg(F.max("ts").alias("last"))
    days = (F.col("last").cast("double") - F.col("ts").cast("double")) / DAY
    w = pairs.join(last, "node").groupBy("node", "neighbour").agg(F.sum(F.pow(F.lit(rate), days)).alias("w")).where(F.col("w") >= least)
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "neighbour"))
    return w.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def claims(requests: DataFrame, reclaim_seconds: int = 300) -> DataFrame:
    """(key, request_id, status): a work queue as state. A request of a key already waiting is a duplicate; a claim too old is given out again.

    `requests` has key, request_id, action (enqueue, claim, complete) and ts.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, holder, at = state.get if state.exists else ("idle", -1, 0.0)
        out = []
        rows = sorted((r for b in batches for r in zip(b["ts"], b["request_id"], b["action"])), key=lambda r: r[:2])
        for ts, request, action in rows:
            now = ts.timestamp()
            if action == "enqueue":
                said = "duplicate" if status in ("waiting", "claimed") else "queued"
                if said == "queued":
                    status, holder, at = "waiting", request, now
            elif action == "claim":
                free = status == "waiting" or (status == "claimed" and now - at >= reclaim_seconds)
                said = "claimed" if free else "empty"
                if free:
                    status, at = "claimed", now
            else:
                said = "completed" if status == "claimed" else "ignored"
                status = "idle" if status == "claimed" else status
            out.append((key[0], int(request), said))
        state.update((status, int(holder), at))
        yield pd.DataFrame(out, columns=["key", "request_id", "status"])

    return requests.groupBy("key").applyInPandasWithState(update, "key string, request_id long, status string", "status string, holder long, at double", "append", GroupStateTimeout.NoTimeout)


def breaker(outcomes: DataFrame, failures: int = 3, cool_seconds: int = 300) -> DataFrame:
    """(key, ts, state): closed, open after so many failures in a row, half-open for one probe after the cool-down."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, 0.0)
        out = []
        for ts, ok in sorted((r for b in batches for r in zip(b["ts"], b["ok"])), key=lambda r: r[0]):
            now = ts.timestamp()
            said = "closed" if not opened else "half-open" if now - opened >= cool_seconds else "open"
            if said != "open":
                run, opened = (0, 0.0) if ok else (run + 1, opened)
                if run >= failures:
                    opened = now
            out.append((key[0], ts, said))
        state.update((int(run), float(opened)))
        yield pd.DataFrame(out, columns=["key", "ts", "state"])

    return outcomes.groupBy("key").applyInPandasWithState(update, "key string, ts timestamp, state string", "run int, opened double", "append", GroupStateTimeout.NoTimeout)


def changed_rows(spark: SparkSession, path: str, schema: str, after: int = -1) -> DataFrame:
    """A stream of a change log's rows with ids above the watermark, as they are appended."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("id") > after)


def debounced(events: DataFrame, key: str, ts: str, quiet: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One flush (key, flush_at, changes) for each run of changes that a quiet time has ended."""
    from lodewell.operators import telemetry

    return telemetry.debounced(events.withWatermark(ts, late), key, ts, quiet)


def pushed(rows: DataFrame, send, key: str, at: str, every: str = "2 seconds", checkpoint: str | None = None):
    """Starts a query that hands the latest row of each key of every micro-batch to `send`, a function of a batch frame; at least once for each."""

    def latest(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        send(newest)

    writer = rows.writeStream.foreachBatch(latest).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def run_due(rows: DataFrame, send, checkpoint: str) -> None:
    """A scheduled run: everything that has come since the last one, then it ends. Two runs on one checkpoint can't overlap: the later one fails."""
    rows.writeStream.foreachBatch(lambda batch, _: send(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
