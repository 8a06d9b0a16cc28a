"""Walks with a cap, counters with a floor, and the co-recall graph as state: restarts, late rows, decay, caps, timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodewell.operators import telemetry as M
from lodewell.operators import walks as W
from lodewell.streaming import pipelines

PAIRS = "node string, neighbour string, ts timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def keyed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    pipelines.keyed_state(spark)
    yield
    spark.conf.set(name, before)


class Stream:
    """A folder of pairs and a query over it that starts anew from its checkpoint for each file."""

    def __init__(self, spark, folder, **settings):
        self.spark, self.folder, self.settings, self.graph, self.told = spark, folder, settings, {}, []
        (folder / "in").mkdir()

    def add(self, *rows):
        n = len(list((self.folder / "in").iterdir()))
        self.spark.createDataFrame(rows, PAIRS).coalesce(1).write.parquet(f"{self.folder}/in/{n}")
        pairs = self.spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        out = pipelines.co_recall_graph(pairs, **self.settings)
        query = out.writeStream.foreachBatch(lambda batch, _: self.told.extend(batch.collect())).outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(180)
        for r in self.told:
            self.graph[r["node"], r["neighbour"]] = r["w"]
        return {k: w for k, w in self.graph.items() if w}


def test_graph_as_state_is_the_batch_form(spark, tmp_path, keyed):
    stream = Stream(spark, tmp_path, late="100 days")
    first = [("a", "b", day(0)), ("a", "b", day(3)), ("a", "c", day(3)), ("b", "a", day(0)), (None, "x", day(1))]
    late = [("a", "b", day(1)), ("a", "d", day(2.5)), ("b", "a", day(9))]
    stream.add(*first)
    got = stream.add(*late)  # from the checkpoint; two rows are older than what the state has
    rows = spark.createDataFrame([r for r in first + late if r[0]], PAIRS)
    expected = {(r["node"], r["neighbour"]): r["w"] for r in pipelines.co_recall_until(rows).collect()}
    # c was not touched in the second batch, and its weight is of the same latest pair
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert abs(got["a", "b"] - (0.98**3 + 0.98**2 + 1)) < 1e-9


def test_state_keeps_the_strongest_and_forgets(spark, tmp_path, keyed):
    stream = Stream(spark, tmp_path, late="1 day", cap=2, least=0.5)
    assert set(stream.add(*[("a", n, day(0)) for n in "bbbccd"])) == {("a", "b"), ("a", "c")}
    stream.add(("z", "y", day(200)))  # time goes on elsewhere
    got = stream.add(("z", "y", day(201)))  # the timer of a's edges is due
    assert {k for k in got if k[0] == "a"} == set() and ("z", "y") in got
    assert ("a", "late") not in stream.add(("a", "late", day(3)))  # later than the watermark allows


def test_walks_end_at_the_cap(spark):
    rnd = random.Random(3)
    edges = sorted({(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(90)})
    frame = spark.createDataFrame([*edges, (1, None), edges[0]], "src long, dst long")
    for direction, hops, limit in (("both", 2, 10), ("out", 3, 50), ("in", 5, 4), ("both", 1, 1)):
        near = {n: set() for n in range(31)}
        for a, b in edges:
            near[a] |= {b} if direction != "in" else set()
            near[b] |= {a} if direction != "out" else set()
        seen, frontier, walked = {1: 0}, [1], set()
        for hop in range(1, hops + 1):
            walked |= set(frontier)
            new = sorted({n for f in frontier for n in near[f]} - set(seen))[: limit - len(seen)]
            seen |= {n: hop for n in new}
            frontier = new
        nodes, found = W.walk(frame, 1, hops, limit, direction)
        assert {r["node"]: r["hops"] for r in nodes.collect()} == seen
        expected = {e for e in edges if (direction != "in" and e[0] in walked) or (direction != "out" and e[1] in walked)}
        assert {tuple(r) for r in found.collect()} == expected
    assert [tuple(r) for r in W.walk(frame, 99, 2)[0].collect()] == [(99, 0)]
    calls = spark.createDataFrame([(1, 2, "f"), (1, None, "print"), (1, None, "print"), (2, None, "len")], "caller_id long, callee_id long, callee_name string")
    assert [tuple(r) for r in W.callees(calls, 1, 2)[2].collect()] == [("print", 2)]


def test_counters_never_fall_below_zero(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("xyz"), day(rnd.randint(0, 4)), i, rnd.choice([None, -9, -3, 1, 2, 5])) for i in range(200)]
    rows += [(None, day(1), 900, -3), (None, day(2), 901, 4), ("w", None, 902, 5), ("w", day(0), 903, -7)]
    got = {r["i"]: r["value"] for r in M.floored(spark.createDataFrame(rows, "k string, at timestamp, i int, change int"), "k", "at", "change", ["i"]).collect()}
    now: dict = {}
    for k, at, i, change in sorted(rows, key=lambda r: (r[1] is not None, r[1] or day(0), r[2])):
        now[k] = max(0, now.get(k, 0) + (change or 0))
        assert got[i] == now[k]
    events = spark.createDataFrame([("t", day(0), 2, 10, None), ("t", day(1), 3, 4, True), ("t", day(2), 1, 1, False)], "tool string, at timestamp, calls int, tokens_saved int, pushed boolean")
    assert tuple(M.savings(events).first())[1:] == (1, 7, day(1))
    assert M.savings(events.limit(0)).count() == 0
