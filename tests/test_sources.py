"""File sources, conversation readers, code tables, and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lodewell.plans import recall as plans
from lodewell.sources import code, conversations, vault
from lodewell.streaming import pipelines


def test_vault(spark, tmp_path):
    (tmp_path / "vault" / "Notes").mkdir(parents=True)
    (tmp_path / "vault" / "Notes" / "A b.md").write_text("---\ntitle: Hello\ntags: [#One, two]\nvalid_from: 2024-01-02T10:00\n---\nBody [[Target|x]]\n- [ ] do it\n- [x] done\n")
    (tmp_path / "vault" / "c.md").write_text("plain")
    (tmp_path / "vault" / "d.txt").write_text("no note")
    files = vault.read_vault(spark, str(tmp_path / "vault"))
    notes = {r.path: r for r in vault.as_notes(files).collect()}
    assert set(notes) == {"Notes/A b.md", "c.md"}
    a = notes["Notes/A b.md"]
    assert (a.title, a.tags, a.collection, a.links, a.valid_from) == ("Hello", ["one", "two"], "Notes", ["Target"], dt.date(2024, 1, 2))
    assert (notes["c.md"].title, notes["c.md"].collection) == ("c", "general")
    assert vault.open_tasks(vault.as_notes(files)).first().tasks == ["- [ ] do it"]
    after, conflicts = vault.compare_and_swap(files, spark.createDataFrame([("c.md", "new", "stale"), ("e.md", "fresh", None)], "path string, content string, if_match string"))
    assert {r.path: r.content for r in after.collect()}["c.md"] == "plain" and after.count() == 3 and conflicts.count() == 1
    text = spark.range(1).select(vault.merged_section(F.lit("# A\nold\n# B\nkeep"), "A", F.lit("new $1")).alias("v")).first().v
    assert text == "# A\nnew $1\n# B\nkeep"


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('# comment\n\n{"a": 1}\n// no\nbroken\n{"a": 2}\n')
    assert [r.a for r in vault.read_jsonl(spark, str(path), "a int").collect()] == [1, 2]


def test_conversations(spark):
    raw = {
        "lines": '{"type":"human","content":"hi"}\n{"type":"assistant","content":[{"text":"hello"}]}\nbroken',
        "session": '{"type":"session","id":"s1"}\n{"role":"user","content":"q"}\n{"role":"assistant","content":"a"}',
        "messages": json.dumps({"chat_messages": [{"sender": "human", "text": "x"}, {"sender": "assistant", "text": "y"}]}),
        "tree": json.dumps({"mapping": {"r": {"parent": None, "children": ["a"]}, "a": {"parent": "r", "children": ["b"], "message": {"author": {"role": "user"}, "content": {"parts": ["p"]}, "create_time": 1.5}}, "b": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["o"]}}}}}),
        "bot": json.dumps([{"user": "u", "text": "m"}, {"user": "u2", "bot_id": "B", "text": "n"}]),
        "quoted": "> ask\n> more\nreply here",
        "unknown": "{ broken",
    }
    rows = conversations.exchanges(spark.createDataFrame(list(raw.items()), "id string, raw string"), "id").collect()
    assert {r.id: (r.source, r.user_message, r.assistant_message) for r in rows} == {
        "lines": ("lines", "hi", "hello"),
        "session": ("session", "q", "a"),
        "messages": ("messages", "x", "y"),
        "tree": ("tree", "p", "o"),
        "bot": ("bot", "m", "n"),
        "quoted": ("quoted", "ask\nmore", "reply here"),
    }
    assert {r.session for r in rows if r.id == "session"} == {"s1"}


def test_code(spark):
    text = 'import os\nfrom a.b import c\n\nclass K:\n    """Doc."""\n    def m(self, x=1):\n        return os.path.join(x)\n\ndef f():\n    K().m(2)\n'
    files = code.source_files(spark.createDataFrame([("x/k.py", text), ("bad.py", "def ("), ("b.bin", "x"), ("n.py", "a\x00")], "path string, content string"))
    rows = code.parsed(files).collect()
    assert {(r["name"], r["kind"], r.qualified_name, r.parent) for r in rows if r.row == "symbol"} == {("K", "class", "K", None), ("m", "method", "K.m", "K"), ("f", "function", "f", None)}
    assert {(r.qualified_name, r["name"]) for r in rows if r.row == "call"} == {("K.m", "join"), ("f", "K"), ("f", "m")}
    assert {(r["name"], r.module) for r in rows if r.row == "import"} == {("os", "os"), ("c", "a.b")}
    prints = [r.v for r in spark.createDataFrame([("a = b + c  # x",), ("a  =  b + c",), ("z(1)",), ("a",)], "t string").select(code.body_simhash(F.col("t")).alias("v")).collect()]
    assert prints[0] == prints[1] != prints[2] and prints[3] == 0


def run_stream(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("u", at(s)) for s in (0, 5, 70, 4000, 9000)], "user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "events"))
    events = pipelines.poll_files(spark, str(tmp_path / "events"), "user string, ts timestamp")
    rows = run_stream(spark, pipelines.sampled(events.withColumn("value", F.lit(1.0)), "ts", "value"), "sampled", "update")
    assert sum(r.n for r in rows) == 5
    rows = run_stream(spark, pipelines.idle_edges(events, "user", "ts"), "idle", "append")
    assert {r.n for r in rows} <= {1, 3} and any(r.n == 3 for r in rows)


def test_stateful_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("n", "b", at(0)), ("n", "c", at(1)), ("n", "b", at(2))], "node string, neighbour string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "pairs"))
    pairs = pipelines.poll_files(spark, str(tmp_path / "pairs"), "node string, neighbour string, ts timestamp")
    assert {r.neighbour: r.w for r in run_stream(spark, pipelines.co_recall_state(pairs), "co", "update")} == {"b": 2.0, "c": 1.0}
    spark.createDataFrame([("k", n, a, at(s)) for n, a, s in ((1, "enqueue", 0), (2, "enqueue", 1), (3, "claim", 2), (4, "claim", 3), (5, "claim", 400), (6, "complete", 401))], "key string, request_id long, action string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "queue"))
    queue = pipelines.poll_files(spark, str(tmp_path / "queue"), "key string, request_id long, action string, ts timestamp")
    assert {r.request_id: r.status for r in run_stream(spark, pipelines.claims(queue), "queue", "append")} == {1: "queued", 2: "duplicate", 3: "claimed", 4: "empty", 5: "claimed", 6: "completed"}
    spark.createDataFrame([("k", at(s), ok) for s, ok in ((0, False), (1, False), (2, False), (3, True), (400, True), (401, True))], "key string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "calls"))
    calls = pipelines.poll_files(spark, str(tmp_path / "calls"), "key string, ts timestamp, ok boolean")
    assert [r.state for r in sorted(run_stream(spark, pipelines.breaker(calls), "breaker", "append"), key=lambda r: r.ts)] == ["closed"] * 3 + ["open", "half-open", "closed"]


def test_recall_plan(spark):
    notes = spark.createDataFrame([(i, f"title {w}", f"{w} is written about here, note {i}", "c", i % 16) for i, w in enumerate(["apple", "pear", "apple", "plum", "applet"])], "doc_id long, title string, content string, collection string, heat int")
    got = plans.recall(notes, "the apple", limit=2).collect()
    assert len(got) == 2 and all("appl" in r.title for r in got) and got[0].reason == "lexical match"
    assert plans.context_block(notes, [F.desc("heat"), F.col("doc_id")], 2, most=40).first().block.endswith("...")
    assert {r.layer for r in plans.wake_up(notes, [F.desc("heat"), F.col("doc_id")]).collect()} == {0, 1, 2}
    assert plans.similar(notes, 0).count() >= 1
    brief = spark.createDataFrame([("mail a.b@c.de or +49 170 1234567",)], "t string")
    assert plans.redacted(brief, "t", "guest").first().t == "mail [mail] or [number]"
