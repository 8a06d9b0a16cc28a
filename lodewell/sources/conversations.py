"""Readers of conversation exports: six raw formats to exchanges, told apart by their first characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The formats' names.
FORMATS = ["lines", "session", "messages", "tree", "bot", "quoted", "unknown"]


def detected(raw: Column) -> Column:
    """The format of a raw export, from its first 2048 characters."""
    head = F.substring(raw, 1, 2048)
    return (
        F.when(head.rlike(r'^\s*\{"type"\s*:\s*"session') | head.rlike(r'^\s*\{"session'), "session")
        .when(head.rlike(r'"mapping"\s*:'), "tree")
        .when(head.rlike(r'"chat_messages"\s*:|^\s*\[\s*\{[^}]*"sender"\s*:'), "messages")
        .when(head.rlike(r'^\s*\[\s*\{[^}]*"(?:bot|user|username)"\s*:'), "bot")
        .when(head.rlike(r'^\s*\{.*"type"\s*:\s*"(?:human|user|assistant)"'), "lines")
        .when(head.rlike(r"(?m)^> "), "quoted")
        .otherwise("unknown")
    )


def _text(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(_text(v) for v in value if v)
    if isinstance(value, dict):
        return _text(value.get("text") or value.get("content") or value.get("parts") or "")
    return ""


def _role(value) -> str | None:
    return {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant"}.get(str(value).lower())


def messages(raw: str, kind: str) -> list[tuple]:
    """(role, text, timestamp, session) of one export, in order; nothing for malformed input."""
    import json

    def load(s):
        try:
            return json.loads(s)
        except ValueError:
            return None

    out: list = []
    if kind in ("lines", "session"):
        session = None
        for line in raw.splitlines():
            row = load(line)
            if not isinstance(row, dict):
                continue
            session = row.get("sessionId") or row.get("session_id") or (row.get("id") if str(row.get("type", "")).startswith("session") else None) or session
            inner = row.get("message") if isinstance(row.get("message"), dict) else row
            role = _role(row.get("role") or inner.get("role") or row.get("type"))
            if role:
                out.append((role, _text(inner.get("content") or inner.get("text")), str(row.get("timestamp") or "") or None, session))
    elif kind in ("messages", "bot"):
        rows = load(raw)
        rows = rows.get("chat_messages", []) if isinstance(rows, dict) else rows or []
        for row in rows if isinstance(rows, list) else []:
            if isinstance(row, dict):
                role = _role(row.get("sender") or row.get("role") or ("assistant" if row.get("bot") or row.get("bot_id") else "user"))
                out.append((role, _text(row.get("text") or row.get("content")), str(row.get("created_at") or row.get("ts") or "") or None, None))
    elif kind == "tree":
        tree = load(raw)
        nodes = tree.get("mapping") if isinstance(tree, dict) else None
        nodes = nodes if isinstance(nodes, dict) else {}
        stack, seen = [k for k, n in reversed(nodes.items()) if not n.get("parent") or n["parent"] not in nodes], set()
        while stack:  # depth first from the roots
            key = stack.pop()
            if key in seen:
                continue
            seen.add(key)
            node = nodes[key]
            message = node.get("message") or {}
            role = _role((message.get("author") or {}).get("role"))
            if role:
                out.append((role, _text(message.get("content")), str(message.get("create_time") or "") or None, None))
            stack += [c for c in reversed(node.get("children") or []) if c in nodes]
    elif kind == "quoted":
        role, held = None, []
        for line in [*raw.splitlines(), None]:
            now = None if line is None else "user" if line.startswith("> ") else "assistant"
            if now != role and held:
                out.append((role, "\n".join(held).strip(), None, None))
                held = []
            if line is not None:
                held.append(line[2:] if now == "user" else line)
            role = now
    return [m for m in out if m[0] and m[1].strip()]


def exchanges(exports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, position, user_message, assistant_message, timestamp, source, session) of each export.

    JSON of unknown depth is walked in Python; each export is one row, and rows come in Arrow batches.
    """
    kind_of_key = dict(exports.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text, kind in zip(batch[key], batch["raw"], batch["source"]):
                pending, position = None, 0
                for role, said, at, session in messages(text or "", kind):
                    if role == "user":
                        pending = (said, at, session)
                    elif pending:
                        rows.append((k, position, pending[0], said, pending[1], kind, pending[2] or session))
                        pending, position = None, position + 1
            yield pd.DataFrame(rows, columns=["key", "position", "user_message", "assistant_message", "timestamp", "source", "session"]).rename(columns={"key": key})

    rows = exports.select(key, F.col(raw).alias("raw"), detected(F.col(raw)).alias("source"))
    return rows.mapInPandas(run, f"{key} {kind_of_key}, position long, user_message string, assistant_message string, timestamp string, source string, session string")
