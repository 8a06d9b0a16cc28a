"""Knowledge-graph building, ingest, tasks and evaluation on worked examples."""

import pytest
from pyspark.sql import functions as F

from lodewell.operators import knowledge as K


def test_bootstrap_and_links(spark):
    notes = spark.createDataFrame([("a", "c1", ["b"], ["t", "t"]), ("b", None, None, None)], "path string, collection string, links array<string>, tags array<string>")
    got = {(r.subject, r.predicate, r.object): r.confidence for r in K.bootstrap(notes).collect()}
    assert got == {("a", "in_collection", "c1"): 1.0, ("a", "links_to", "b"): 0.8, ("a", "tagged", "t"): 1.0}
    rows = spark.createDataFrame([("p", "o", None)], "person string, organisation string, project string")
    assert [tuple(r) for r in K.linked_entities(rows).collect()] == [("p", "works_at", "o")]


def test_ingest_and_pull(spark):
    payload = spark.createDataFrame(
        [("r", [("x.py", "h1", [("f", 1)]), ("y.py", "h2", [("g", 2)])])], "repo_id string, files array<struct<relative_path:string,content_hash:string,symbols:array<struct<name:string,start_line:int>>>>"
    )
    known = spark.createDataFrame([("r", "x.py", "h1")], "repo_id string, relative_path string, content_hash string")
    got = K.ingest(payload, known)
    assert [r.relative_path for r in got["files"].collect()] == ["y.py"] and [r.name for r in got["symbols"].collect()] == ["g"]
    files = spark.createDataFrame([("r", "x.py", 5), ("r", "y.py", 9)], "repo_id string, relative_path string, indexed_at long")
    symbols = spark.createDataFrame([("r", "y.py", 3, "b", "k", "2"), ("r", "y.py", 1, "a", "k", "1")], "repo_id string, relative_path string, start_line int, name string, kind string, id string")
    (row,) = K.pull(files, symbols, 9).collect()
    assert [s["name"] for s in row.symbols] == ["a", "b"]
    assert K.apply_pull(files, files.where("indexed_at = 9"), False, ["repo_id", "relative_path"]).count() == 2 and K.apply_pull(files, files.limit(0), True, ["repo_id"]).count() == 0


def test_calls(spark):
    symbols = spark.createDataFrame([("r", "f", "1", "function", "a.py"), ("r", "g", "2", "function", "a.py"), ("s", "h", "3", "function", "b.py"), ("s", "g", "4", "function", "tests/x.py")], "repo_id string, name string, id string, kind string, relative_path string")
    calls = spark.createDataFrame([("r", "2", n) for n in "fgh"], "repo_id string, caller_id string, callee_name string")
    got = lambda imports: {r.callee_name: r.callee_id for r in K.resolved_calls(calls, symbols, spark.createDataFrame(imports, "repo_id string, resolved_repo string")).collect()}
    assert got([]) == {"f": "1", "g": "2", "h": None} and got([("r", "s")]) == {"f": "1", "g": None, "h": "3"}
    assert {r.id for r in K.dead_symbols(symbols, spark.createDataFrame([("1",)], "callee_id string")).collect()} == {"2", "3"}
    around = spark.createDataFrame([("a", "K", 1, 900), ("a", "m", 300, 310)], "path string, name string, start_line int, end_line int")
    at = spark.createDataFrame([("a", 305), ("a", 20), ("a", 901)], "path string, line int")
    assert {r.line: r.symbol for r in K.enclosing(at, around).collect()} == {305: "m", 20: "K", 901: None}


def test_tasks_and_preferences(spark):
    tasks = spark.createDataFrame([("Do  it", "open"), ("done", "closed")], "title string, status string")
    got = K.task_upsert(tasks, spark.createDataFrame([("do it",), ("Done",), ("new",)], "title string"))
    assert {r.title: r.action for r in got.collect()} == {"do it": "update", "Done": "skip", "new": "create"}
    known = spark.createDataFrame([("like", "black tea")], "kind string, phrase string")
    found = spark.createDataFrame([("like", "strong black tea"), ("like", "green fields"), ("rule", "black tea"), ("like", "blacktea")], "kind string, phrase string")
    assert {(r.kind, r.phrase) for r in K.new_preferences(found, known).collect()} == {("like", "green fields"), ("rule", "black tea")}
    lines = K.diary(spark.createDataFrame([("x _via bot_", 1), ("_(silent)_ y _via bot_", 3), ("z", 4)], "line string, at long"))
    assert [tuple(r) for r in K.roster(lines).collect()] == [("bot", 2, 3)] and lines.where("silent").count() == 1


def test_clusters_search_and_evaluation(spark):
    notes = spark.createDataFrame([(1, "a", "A", "2024-01-01", ["x", "y"]), (1, "b", "B", "2024-02-01", ["x"])], "c long, path string, title string, date string, tags array<string>")
    (row,) = K.merged_cluster(notes, "c").collect()
    assert (row.title, row.sources, row.tags) == ("B", ["a", "b"], ["x"])
    tools = spark.createDataFrame([("find notes", "search", 0.1), ("other", "x", 0.5)], "name string, description string, cosine double")
    assert [r.name for r in K.tool_search(tools, ["find", "search"]).collect()] == ["find notes", "other"]
    traces = spark.createDataFrame([("fix the login bug", None, "## Plan\nx\n## Outcome\nworked\n"), ("paint", None, "")], "goal string, expires string, content string")
    assert [r.outcome for r in K.trace_search(traces, "fix login", as_of="2024-01-01").collect()] == ["worked"]
    links = spark.createDataFrame([("a", "b"), ("a", "a")], "src string, dst string")
    assert {r.query: r.expected for r in K.gold_set(notes, links).collect()} == {"A": ["a", "b"], "B": ["b"]}
    results = spark.createDataFrame([("new fact", ["new"], ["old"]), ("old new", ["new"], ["old"]), ("x", ["x"], [])], "top string, expect array<string>, absent array<string>")
    (row,) = K.point_in_time(results).collect()
    assert (row.recall, row.point_in_time, row.stale_leak) == (1.0, 0.5, 0.5)
    rows = spark.range(50).withColumnRenamed("id", "k")
    assert sorted(r.k for r in K.seeded_sample(rows, "k", 5, 1).collect()) == sorted(r.k for r in K.seeded_sample(rows.repartition(7), "k", 5, 1).collect())
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "a", 3.0), ("a", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, w double")
    assert K.strongest_edges(edges, 1).count() == 2 and pytest.approx(1.0) == 1.0
    assert K.recent_first(notes.withColumn("date", F.when(F.col("path") == "a", F.col("date"))), "date").first().path == "a"
