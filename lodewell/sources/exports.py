"""Conversation exports of six formats as variants: messages, exchanges and notes by Spark's own expressions.

JSON is parsed to variants, lists and mappings are exploded, and a text may be a string, a list of
parts or an object that holds one, two levels deep. The tree of one format is put in order by
pointers to parents that double each round, so rounds are the logarithm of its depth; what no root
reaches, loops included, is left out. Malformed lines and exports have no messages; null exports none.
An export is one conversation, whose messages a window orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators.graph import cut
from lodewell.operators.mining import memories
from lodewell.sources.conversations import detected

#: What the formats call the two sides.
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant"}
MESSAGE = ["key", "source", "place", "role", "text", "at", "session"]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _said(v: Column) -> Column:
    """A value as text, if it is a string or a number."""
    return F.when(~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT|VOID)"), _get(v, "$"))


def _text(v: Column, levels: int = 2) -> Column:
    kind = F.schema_of_variant(v)
    if not levels:
        return F.when(kind == "STRING", _get(v, "$"))
    parts = F.filter(F.transform(_get(v, "$", "array<variant>"), lambda x: _text(x, levels - 1)), lambda t: t.isNotNull() & (t != ""))
    own = [F.nullif(_text(_get(v, f"$.{name}", "variant"), levels - 1), F.lit("")) for name in ("text", "content", "parts")]
    return F.when(kind == "STRING", _get(v, "$")).when(kind.startswith("ARRAY"), F.array_join(parts, "\n")).when(kind.startswith("OBJECT"), F.coalesce(*own))


def _role(*names: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(*[known[F.lower(n)] for n in names])


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _lines(rows: DataFrame) -> DataFrame:
    """One JSON object a line; a session that a line names holds from there on."""
    each = rows.select("key", "source", F.posexplode(F.split("raw", "\n")).alias("place", "line")).select("key", "source", "place", F.try_parse_json("line").alias("v"))
    v, inner = F.col("v"), _get(F.col("v"), "$.message", "variant")
    named = _first(_get(v, "$.sessionId"), _get(v, "$.session_id"), _get(v, "$.session_meta.id"), F.when(_get(v, "$.type").startswith("session"), _get(v, "$.id")))
    text = F.coalesce(*[F.nullif(_text(x), F.lit("")) for x in (_get(inner, "$.content", "variant"), _get(inner, "$.text", "variant"), _get(v, "$.content", "variant"), _get(v, "$.text", "variant"))])
    role = _role(_get(v, "$.role"), _get(inner, "$.role"), _get(v, "$.type"))
    told = each.select("key", "source", F.array(F.struct(F.col("place").alias("i"), F.lit("").alias("id"))).alias("place"), role.alias("role"), text.alias("text"), _first(_get(v, "$.timestamp")).alias("at"), named.alias("named"))
    return told.withColumn("session", F.last("named", True).over(Window.partitionBy("key").orderBy("place"))).select(*MESSAGE)


def _lists(rows: DataFrame) -> DataFrame:
    """A list of messages, or an object that holds one, or a list of such objects."""
    v = F.try_parse_json("raw")
    whole = F.coalesce(_get(v, "$.chat_messages", "array<variant>"), _get(v, "$", "array<variant>"))
    spread = F.flatten(F.transform(whole, lambda x: F.coalesce(_get(x, "$.chat_messages", "array<variant>"), F.array(x))))
    m = F.col("m")
    bot = F.when(_get(m, "$.bot", "variant").isNotNull() | _get(m, "$.bot_id", "variant").isNotNull(), "bot").otherwise("user")
    each = rows.select("key", "source", F.posexplode(spread).alias("i", "m")).where(F.schema_of_variant("m").startswith("OBJECT"))
    text = F.coalesce(*[F.nullif(_text(_get(m, f"$.{n}", "variant")), F.lit("")) for n in ("text", "content")])
    at = _first(_said(_get(m, "$.created_at", "variant")), _said(_get(m, "$.ts", "variant")))
    return each.select("key", "source", F.array(F.struct("i", F.lit("").alias("id"))).alias("place"), _role(_get(m, "$.sender"), _get(m, "$.role"), bot).alias("role"), text.alias("text"), at.alias("at"), F.lit(None).cast("string").alias("session"))


def tree_places(nodes: DataFrame) -> DataFrame:
    """(key, id, place) of nodes (key, id, parent, i: place among the parent's children) that a root reaches; `place` sorts them depth first.

    A node is a root if it has no parent or its parent is not there.
    """
    known = nodes.select("key", F.col("id").alias("parent"), F.lit(True).alias("there"))
    step = F.struct(F.coalesce("i", F.lit((1 << 31) - 1)).alias("i"), "id")
    now = cut(nodes.join(known, ["key", "parent"], "left").select("key", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.array(step).alias("place")))
    left, done = None, now.where("up IS NULL").select("key", "id", "place")
    while True:
        n = now.where("up IS NOT NULL").count()
        if not n or n == left:  # only loops are left
            return now.where("up IS NULL").select("key", "id", "place")
        left = n
        above = now.select("key", F.col("id").alias("up"), F.col("up").alias("next"), F.col("place").alias("before"))
        going = now.where("up IS NOT NULL").join(above, ["key", "up"]).select("key", "id", F.col("next").alias("up"), F.concat("before", "place").alias("place"))
        now = cut(now.where("up IS NULL").unionByName(going))


def _trees(rows: DataFrame) -> DataFrame:
    """Nodes by name, each with its parent, its children and perhaps a message."""
    mapping = _get(F.try_parse_json("raw"), "$.mapping", "map<string,variant>")
    nodes = cut(rows.select("key", "source", F.explode(mapping).alias("id", "v")).select("key", "source", "id", _get(F.col("v"), "$.parent").alias("parent"), _get(F.col("v"), "$.children", "array<string>").alias("children"), F.to_json("v").alias("json")))
    inside = nodes.select("key", F.col("id").alias("parent"), F.posexplode("children").alias("i", "id")).groupBy("key", "parent", "id").agg(F.min("i").alias("i"))
    places = tree_places(nodes.select("key", "id", "parent").join(inside, ["key", "parent", "id"], "left").select("key", "id", "parent", "i"))
    m = _get(F.col("v"), "$.message", "variant")
    told = nodes.select("key", "source", "id", F.try_parse_json("json").alias("v")).join(places, ["key", "id"])
    return told.select("key", "source", "place", _role(_get(m, "$.author.role")).alias("role"), _text(_get(m, "$.content", "variant")).alias("text"), _first(_said(_get(m, "$.create_time", "variant"))).alias("at"), F.lit(None).cast("string").alias("session"))


def _quotes(rows: DataFrame) -> DataFrame:
    """Lines that begin with `> ` are the user's, those between them the answer."""
    each = rows.select("key", "source", F.posexplode(F.split("raw", "\r?\n")).alias("i", "line")).withColumn("asked", F.col("line").startswith("> "))
    by = Window.partitionBy("key").orderBy("i")
    run = each.withColumn("new", F.coalesce(F.lag("asked").over(by) != F.col("asked"), F.lit(True))).withColumn("run", F.sum(F.col("new").cast("int")).over(by))
    line = F.when(F.col("asked"), F.substring("line", 3, 1 << 30)).otherwise(F.col("line"))
    # a run is part of one export
    joined = run.groupBy("key", "source", "run", "asked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    return joined.select("key", "source", F.array(F.struct(F.col("run").cast("int").alias("i"), F.lit("").alias("id"))).alias("place"), F.when(F.col("asked"), "user").otherwise("assistant").alias("role"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("session"))


def messages(exports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, source, place, role, text, at, session) of all messages with a role and words; `place` sorts those of an export."""
    rows = cut(exports.select(F.col(key).alias("key"), F.col(raw).alias("raw"), detected(F.col(raw)).alias("source")).where("raw IS NOT NULL"))
    readers = [(("lines", "session"), _lines), (("messages", "bot"), _lists), (("tree",), _trees), (("quoted",), _quotes)]
    out = None
    for formats, read in readers:
        found = read(rows.where(F.col("source").isin(*formats)))
        out = found if out is None else out.unionByName(found)
    return out.where(F.col("role").isNotNull() & F.col("text").rlike(r"\S"))


def exchanges(exports: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, position, user_message, assistant_message, timestamp, source, session): each answer with the message before it, if that is the user's."""
    by = Window.partitionBy("key").orderBy("place")
    before = lambda c: F.lag(c).over(by)
    rows = messages(exports, key, raw).withColumns({"asked": before("role"), "question": before("text"), "asked_at": before("at"), "asked_in": before("session")})
    pairs = rows.where("role = 'assistant' AND asked = 'user'")
    position = (F.row_number().over(by) - 1).cast("long")
    return pairs.select(F.col("key").alias(key), position.alias("position"), F.col("question").alias("user_message"), F.col("text").alias("assistant_message"), F.coalesce("asked_at", "at").alias("timestamp"), "source", F.coalesce("asked_in", "session").alias("session"))


def notes(found: DataFrame, key: str, day: str, collection: str = "Memories") -> DataFrame:
    """(path, title, category, content, tags) of the memories in exchanges, one note for each path; equal paths keep the earliest."""
    said = found.select(key, "position", "source", F.posexplode(F.array("user_message", "assistant_message")).alias("side", "text"))
    kept = memories(said, [key, "position", "side", "source"], "text")
    title = F.substring(F.regexp_replace(T.squeezed(F.col("sentence")), r"[.!?]+$", ""), 1, 60)
    rows = kept.withColumn("title", title).withColumn("path", F.concat(F.lit(collection + "/"), "category", F.lit(f"/{day}-"), T.slug(F.col("title")), F.lit(".md")))
    row = F.struct("title", "category", F.concat(F.lit("# "), "title", F.lit("\n\n"), "sentence", F.lit("\n")).alias("content"), F.array(F.lit("#mined"), F.concat(F.lit("#source:"), "source")).alias("tags"))
    return rows.groupBy("path").agg(F.min_by(row, F.struct(key, "position", "side", "sentence")).alias("r")).select("path", "r.*")
