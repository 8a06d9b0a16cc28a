"""Conversation exports as variants: the formats, trees with branches and loops, malformed input, notes."""

import json

from lodewell.sources import exports as X


def read(spark, *raws):
    rows = X.exchanges(spark.createDataFrame(list(enumerate(raws)), "id long, raw string"), "id").collect()
    return {(r["id"], r["position"]): (r["source"], r["user_message"], r["assistant_message"], r["timestamp"], r["session"]) for r in rows}


def node(role, text, parent, *children, at=None):
    return {"parent": parent, "children": list(children), "message": role and {"author": {"role": role}, "content": {"parts": [text]}, "create_time": at}}


def test_formats(spark):
    lines = "\n".join(['{"type":"user","message":{"content":[{"type":"text","text":"q"},{"type":"image"},{"text":"more"}]},"timestamp":"t1","sessionId":"s1"}', "{broken", '{"type":"assistant","message":{"content":"a"}}', '{"type":"assistant","message":{"content":"again"}}', '{"type":"user","content":"   "}'])
    session = '{"session_meta":{"id":"s9"}}\n{"role":"user","content":"hi"}\n{"role":"user","content":"second"}\n{"role":"assistant","content":"there"}'
    chat = json.dumps({"chat_messages": [{"sender": "human", "text": "x", "created_at": "2024"}, {"sender": "assistant", "content": [{"text": "y"}]}, "odd", None]})
    many = json.dumps([{"sender": "human", "text": "x"}, {"sender": "assistant", "text": "z"}])
    bot = json.dumps([{"user": "u", "text": "p", "ts": 12.5}, {"bot_id": "b", "text": "r"}])
    quoted = "> what\n> now\nthis\n\nand that\n> bye"
    got = read(spark, lines, session, chat, many, bot, quoted, "nothing", None, "")
    assert got == {
        (0, 0): ("lines", "q\nmore", "a", "t1", "s1"),
        (1, 0): ("session", "second", "there", None, "s9"),
        (2, 0): ("messages", "x", "y", "2024", None),
        (3, 0): ("messages", "x", "z", None, None),
        (4, 0): ("bot", "p", "r", "12.5", None),
        (5, 0): ("quoted", "what\nnow", "this\n\nand that", None, None),
    }


def test_trees(spark):
    deep = {f"n{i}": node("user" if i % 2 else "assistant", f"t{i}", f"n{i - 1}" if i else None, f"n{i + 1}") for i in range(40)}
    branches = {
        "r": node(None, None, None, "b", "a"),
        "a": node("user", "second", "r", "a1"),
        "a1": node("assistant", "of second", "a"),
        "b": node("user", "first", "r", "b1", "b2"),
        "b1": node("assistant", "of first", "b", at=5),
        "b2": node("assistant", "other", "b"),
        "x": node("user", "loop", "y", "y"),
        "y": node("assistant", "loop", "x", "x"),
        "lost": node("user", "parent is not there", "gone", "l1"),
        "l1": node("assistant", "still told", "lost"),
    }
    got = read(spark, json.dumps({"mapping": deep}), json.dumps({"mapping": branches}), '{"mapping": {}}', '{"mapping": 3}', '{"mapping": {"a": {"parent": "a", "children": ["a"]}}}', '{"mapping": broken')
    assert [got[0, i][1:3] for i in range(19)] == [(f"t{i}", f"t{i + 1}") for i in range(1, 39, 2)]
    assert {v[1:3] for k, v in got.items() if k[0] == 1} == {("first", "of first"), ("second", "of second"), ("parent is not there", "still told")}
    assert got[1, 0][3] is not None or got[1, 1][3] is not None or got[1, 2][3] is not None
    assert {k[0] for k in got} == {0, 1}


def test_notes(spark):
    found = X.exchanges(spark.createDataFrame([(1, "> why\nWe decided to use the blue one. Nothing else of note here.\n> and\nWe decided to use the blue one."), (2, "> x\nThe bug is a crash of the server!")], "id long, raw string"), "id")
    rows = {r["path"]: r for r in X.notes(found, "id", "2024-01-02").collect()}
    assert set(rows) == {"Memories/decision/2024-01-02-we-decided-to-use-the-blue-one.md", "Memories/problem/2024-01-02-the-bug-is-a-crash-of-the-server.md"}
    one = rows["Memories/decision/2024-01-02-we-decided-to-use-the-blue-one.md"]
    assert one["tags"] == ["#mined", "#source:quoted"] and one["content"].startswith("# We decided to use the blue one\n\n") and one["category"] == "decision"
