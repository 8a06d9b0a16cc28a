"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results are hash-joined by conversation and identifier. A call may name calls of its
conversation that it depends on; calls of a conversation are ordered so that each follows those.
Where every dependency points to an earlier turn, the turns are such an order already; only the
other conversations run rounds of Kahn's algorithm. Arguments are validated against the tool's schema, and every message becomes a
line of canonical JSON: keys sorted, no white space.

A row of null conversation has no position and links with nothing, one of null turn no position;
a call without identifier stays `unanswered`, a result without one is an `orphan`. An empty text is an empty argument or content, a null one JSON's null. Repeated rows keep
a line each, and a link to whatever has the identifier. DataFrame functions only; no conversation
is ever gathered in one row or task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import discard, table, written

#: The schemas of the tools that plain conversations are read as calls of: fields and their rules, or an
#: object's rule. A rule has a type, and may be required, have bounds (of a number, a text's letters, an array's items), a
#: list of values, rules for items or fields, and be closed to other fields.
SCHEMAS = {
    "reply": {"prompt": {"type": "string", "required": True, "least": 40}, "turn": {"type": "integer", "required": True}},
    "review": {
        "type": "object",
        "closed": True,
        "fields": {
            "lines": {"type": "array", "required": True, "least": 2, "most": 6, "items": {"type": "string", "least": 20}},
            "style": {"type": "object", "required": True, "closed": True, "fields": {"kind": {"type": "string", "enum": ["long", "short"]}, "letters": {"type": "integer", "most": 400}}},
        },
    },
}
#: Letters of a text from which on its call waits for the next one, is called medium, or too long.
WAITS, MEDIUM, TOO_LONG = 300, 150, 400
#: Turns of one conversation that are counted together.
STRETCH = 256
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def from_conversations(turns: DataFrame) -> DataFrame:
    """Plain conversations as messages: a user's turn is a call, the turn after it answers that call.

    A text of one line calls `reply` with the text and the turn, one of several lines `review` with the
    lines, their style, and for one of more than TOO_LONG letters a field that the schema doesn't know.
    A call of more than WAITS letters depends on the call two turns later, one of MEDIUM letters or fewer
    on the call two turns before, if there is one; so some conversations have to be ordered, and in some
    calls wait for each other.
    """
    conv, turn, text = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string")
    key = lambda back: F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), (turn - back).cast("string"))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    letters, several = F.coalesce(F.length(text), F.lit(0)), F.coalesce(text.contains("\n"), F.lit(False))
    as_json = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    style = F.struct(F.when(letters > WAITS, "long").when(letters > MEDIUM, "medium").otherwise("short").alias("kind"), letters.alias("letters")).alias("style")
    lines = F.split(text, "\n").alias("lines")
    review = F.when(letters > TOO_LONG, as_json(letters.alias("extra"), lines, style)).otherwise(as_json(lines, style))
    arguments = F.when(several, review).otherwise(as_json(text.alias("prompt"), turn.alias("turn")))
    return turns.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.col("role").cast("string").alias("role"),
        kind.alias("kind"),
        F.when(kind == "call", key(0)).when(kind == "result", key(1)).alias("call_id"),
        F.when(kind == "call", F.when(several, "review").otherwise("reply")).alias("name"),
        F.when(kind == "call", arguments).alias("arguments"),
        F.when((kind == "call") & (letters > WAITS), F.array(key(-2))).when((kind == "call") & (letters <= MEDIUM), F.array(key(2))).otherwise(F.array().cast("array<string>")).alias("needs"),
        text.alias("content"),
    )


def _wrong(value: Column, rule: dict, path: str) -> Column:
    """What is wrong with a value, as an array of `path:problem`: its own first, then those of its fields in order of names, of unknown fields, of its items (each kind once)."""
    kind = F.schema_of_variant(value)
    missing = kind.isNull() | (kind == "VOID")
    other = ~F.regexp_extract(kind, "^[A-Z]+", 0).isin(_TYPES[rule["type"]])
    says = F.when(missing, f"{path}:missing" if rule.get("required") else None).when(other, f"{path}:type")
    items = F.try_variant_get(value, "$", "array<variant>")
    if rule["type"] in ("string", "array"):
        size, low, high = F.length(F.try_variant_get(value, "$", "string")) if rule["type"] == "string" else F.size(items), "short", "long"
    else:
        size, low, high = F.try_variant_get(value, "$", "double"), "small", "large"
    if "least" in rule:
        says = says.when(size < rule["least"], f"{path}:{low}")
    if "most" in rule:
        says = says.when(size > rule["most"], f"{path}:{high}")
    if "enum" in rule:
        says = says.when(~F.try_variant_get(value, "$", "string").isin(rule["enum"]), f"{path}:value")
    parts = [F.array_compact(F.array(says.cast("string")))]
    if rule["type"] == "object":
        parts += _fields(value, rule, f"{path}.")
    if "items" in rule:
        parts.append(F.array_distinct(F.flatten(F.transform(items, lambda x: _wrong(x, rule["items"], f"{path}.*")))))
    return F.when(~missing & ~other, F.concat(*parts)).otherwise(parts[0])


def _fields(value: Column, rule: dict, before: str) -> list[Column]:
    fields = rule.get("fields", {})
    out = [_wrong(F.try_variant_get(value, f"$.{name}", "variant"), inner, before + name) for name, inner in sorted(fields.items())]
    if rule.get("closed"):
        names = F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<string>"))
        unknown = F.array_sort(F.array_except(names, F.array(*[F.lit(n) for n in fields]).cast("array<string>")))
        out.append(F.transform(unknown, lambda n: F.concat(F.lit(before), n, F.lit(":unknown"))))
    return out


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, joined by commas in the order of names; empty if nothing."""
    value = F.try_parse_json(arguments)
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for tool, schema in schemas.items():
        rule = schema if schema.get("type") == "object" else {"fields": schema}
        found = F.array_join(F.concat(*_fields(value, rule, "")), ",") if rule.get("fields") or rule.get("closed") else F.lit("")
        out = out.when(name == tool, F.when(value.isNull(), "not json").otherwise(found))
    return out.otherwise("unknown tool")


def ordered(messages: DataFrame) -> DataFrame:
    """Adds `level`: 0 where turns are an order already, else above the levels of all that a call needs; -1 in a cycle, and behind one."""
    calls = messages.where("kind = 'call' AND conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", "turn", "needs")
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need"))
    turn_of = calls.groupBy("conv_id", F.col("call_id").alias("need")).agg(F.max("turn").alias("need_turn"))
    edges = edges.join(turn_of.hint("shuffle_hash"), ["conv_id", "need"]).groupBy("conv_id", "call_id", "need").agg(F.min("turn").alias("turn"), F.max("need_turn").alias("need_turn"))
    edges = written(edges, "dependencies")
    disordered = edges.where("need_turn >= turn").select("conv_id").distinct()
    if disordered.isEmpty():
        return messages.withColumn("level", F.lit(0).cast("long"))
    placed = levels(calls.join(disordered, "conv_id").select(*CALL).distinct(), edges.join(disordered, "conv_id").select("conv_id", "call_id", "need"))
    return messages.join(placed, CALL, "left").withColumn("level", F.coalesce("level", F.lit(0).cast("long")))


CALL = ["conv_id", "call_id"]


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from distinct calls and their needs: the length of the longest chain of needs, -1 where one never ends.

    A round of Kahn's algorithm places the calls that need nothing unplaced, and with them all that
    hang from them by single needs: pointers double along such chains, so a chain takes as many
    steps as its length has bits. Rounds go on until nothing is freed; each is written.
    """
    left, edges, placed = written(calls.withColumn("least", F.lit(0).cast("long")), "unplaced"), written(edges, "needs"), []
    while True:
        needs = edges.groupBy(*CALL).agg(F.count("*").alias("n"), F.min("need").alias("need"))
        # `top` is where a chain of single needs has led, `depth` how far that is, `floor` the level that the chain below `top` demands
        top = F.when(F.col("n") == 1, F.col("need")).alias("top")
        chains = written(left.join(needs, CALL, "left").select(*CALL, top, F.lit(1).cast("long").alias("depth"), F.col("least").alias("floor"), F.col("n").isNull().alias("free")), "chains")
        for _ in range(chains.count().bit_length() + 1):  # what still moves after that runs in a cycle
            above = chains.where("top IS NOT NULL").select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("beyond"), F.col("depth").alias("further"), F.col("floor").alias("demand"))
            joined = chains.join(above, ["conv_id", "top"], "left")
            depth = (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")
            floor = F.greatest("floor", F.col("demand") + F.col("depth")).alias("floor")
            moved = written(joined.select(*CALL, F.coalesce("beyond", "top").alias("top"), depth, floor, "free", F.col("beyond").isNotNull().alias("moved")), "chains")
            discard(chains)
            chains = moved
            if chains.where("moved").isEmpty():
                break
        free = chains.where("free")
        hanging = chains.join(free.select("conv_id", F.col("call_id").alias("top"), F.col("floor").alias("base")), ["conv_id", "top"])
        new = written(free.select(*CALL, F.col("floor").alias("level")).unionByName(hanging.select(*CALL, F.greatest("floor", F.col("base") + F.col("depth")).alias("level"))), "placed")
        discard(chains)
        if new.isEmpty():
            break
        placed = [*placed, new] if len(placed) < 16 else [written(reduce(DataFrame.unionByName, [*placed, new]), "placed")]
        gone = edges.join(new.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"], "left")
        raised = gone.where("level IS NOT NULL").groupBy(*CALL).agg((F.max("level") + 1).alias("raised"))
        rest = written(left.join(new, CALL, "left_anti").join(raised, CALL, "left").select(*CALL, F.greatest("least", "raised").alias("least")), "unplaced")
        remaining = written(gone.where("level IS NULL").select("conv_id", "call_id", "need"), "needs")
        discard(left)
        discard(edges)
        left, edges = rest, remaining
    return reduce(DataFrame.unionByName, [*placed, left.select(*CALL, F.lit(-1).cast("long").alias("level"))])


def positioned(messages: DataFrame) -> DataFrame:
    """Adds `position`: gapless from 0 in each conversation by level and turn, counted in stretches of turns; none without conversation or turn."""
    stretched = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    counts = stretched.groupBy("conv_id", "level", "stretch").agg(F.count("*").alias("n"))
    shifts = counts.select("conv_id", "level", "stretch", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "stretch")) - F.col("n")).alias("shift"))
    place = F.row_number().over(Window.partitionBy("conv_id", "level", "stretch").orderBy("turn", "kind", "line")) - 1
    numbered = stretched.withColumn("place", place).join(shifts, ["conv_id", "level", "stretch"])
    numbered = numbered.select(*messages.columns, (F.col("shift") + F.col("place")).cast("long").alias("position"))
    return numbered.unionByName(messages.where("conv_id IS NULL OR turn IS NULL").withColumn("position", F.lit(None).cast("long")))


def serialised(messages: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, kind, call_id, needs, problems, line: what moves from here on holds each text once."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    value = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), value(F.col("arguments")))
    call = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), value(F.col("call_id")), F.lit(',"name":'), value(F.col("name")), F.lit(',"type":"call"}'))
    result = F.concat(F.lit('{"content":'), value(F.col("content")), F.lit(',"id":'), value(F.col("call_id")), F.lit(',"type":"result"}'))
    other = F.concat(F.lit('{"content":'), value(F.col("content")), F.lit(',"role":'), value(F.col("role")), F.lit(',"type":"message"}'))
    line = F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(other)
    wrong = F.when(F.col("kind") == "call", problems(F.col("name"), F.col("arguments"), schemas))
    return messages.select("conv_id", "turn", "kind", "call_id", "needs", wrong.alias("problems"), line.alias("line"))


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, position, level, kind, call_id, status, problems, line: a row for each message."""
    lines = serialised(messages, SCHEMAS if schemas is None else schemas)
    messages = written(positioned(ordered(lines)).drop("needs"), "messages")
    named = messages.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    called = named.where("kind = 'call'").select(*CALL).distinct().withColumn("called", F.lit(True))
    answered = named.where("kind = 'result'").select(*CALL).distinct().withColumn("answered", F.lit(True))
    linked = named.join(called.hint("shuffle_hash"), CALL, "left").join(answered.hint("shuffle_hash"), CALL, "left")
    unnamed = messages.where("conv_id IS NULL OR call_id IS NULL")  # matches nothing, so it need not move
    linked = linked.unionByName(unnamed.withColumns({"called": F.lit(None).cast("boolean"), "answered": F.lit(None).cast("boolean")}))
    status = F.when((F.col("kind") == "call") & (F.col("level") < 0), "cycle").when(F.col("kind") == "call", F.when(F.col("answered"), "linked").otherwise("unanswered"))
    status = status.when(F.col("kind") == "result", F.when(F.col("called"), "linked").otherwise("orphan")).otherwise("message")
    return linked.select("conv_id", "turn", "position", "level", "kind", "call_id", status.alias("status"), "problems", "line")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(from_conversations(table(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, length(text) AS n, contains(text, chr(10)) AS several,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'c' || conv_id || '-' || turn WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id,
         CASE role WHEN 'user' THEN 'c' || conv_id || '-' || CASE WHEN length(text) > 300 THEN turn + 2 WHEN length(text) <= 150 THEN turn - 2 END END AS need
  FROM conversations
), calls AS (SELECT DISTINCT conv_id, turn, call_id, need FROM m WHERE kind = 'call'), results AS (SELECT DISTINCT call_id FROM m WHERE kind = 'result'
), edges AS (SELECT a.conv_id, a.call_id, a.need, b.turn >= a.turn AS later FROM calls a JOIN calls b ON b.call_id = a.need
), disordered AS (SELECT conv_id, count(DISTINCT call_id) AS most FROM calls WHERE conv_id IN (SELECT conv_id FROM edges WHERE later) GROUP BY conv_id
), walks AS (
  SELECT call_id, call_id AS at, 0 AS depth, most FROM calls JOIN disordered USING (conv_id)
  UNION ALL SELECT walks.call_id, edges.need, depth + 1, most FROM walks JOIN edges ON edges.call_id = walks.at WHERE depth < most
), levels AS (SELECT call_id, CASE WHEN max(depth) >= any_value(most) THEN -1 ELSE max(depth) END AS level FROM walks GROUP BY call_id
), lines AS (
  SELECT m.*, coalesce(level, 0) AS level, string_split(text, chr(10)) AS parts FROM m LEFT JOIN levels USING (call_id)
)
SELECT conv_id, turn, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY level, turn, kind, text) - 1 END AS position, CAST(level AS BIGINT) AS level, kind, m.call_id AS call_id,
       CASE kind WHEN 'call' THEN CASE WHEN level < 0 THEN 'cycle' WHEN results.call_id IS NULL THEN 'unanswered' ELSE 'linked' END
                 WHEN 'result' THEN CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'message' END AS status,
       CASE WHEN kind <> 'call' THEN NULL WHEN several
            THEN concat_ws(',', CASE WHEN len(parts) > 6 THEN 'lines:long' END, CASE WHEN list_min(list_transform(parts, lambda x: length(x))) < 20 THEN 'lines.*:short' END, CASE WHEN n > 150 AND n <= 300 THEN 'style.kind:value' END,
                           CASE WHEN n > 400 THEN 'style.letters:large' END, CASE WHEN n > 400 THEN 'extra:unknown' END)
            WHEN n < 40 THEN 'prompt:short' ELSE '' END AS problems,
       CASE WHEN kind = 'call' AND several
            THEN '{"arguments":{' || CASE WHEN n > 400 THEN '"extra":' || n || ',' ELSE '' END || '"lines":' || CAST(to_json(parts) AS VARCHAR) || ',"style":{"kind":"' || CASE WHEN n > 300 THEN 'long' WHEN n > 150 THEN 'medium' ELSE 'short' END || '","letters":' || n || '}},"id":"' || m.call_id || '","name":"review","type":"call"}'
            WHEN kind = 'call' THEN '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":"' || m.call_id || '","name":"reply","type":"call"}'
            WHEN kind = 'result' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || m.call_id || '","type":"result"}'
            ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '","type":"message"}' END AS line
FROM lines m LEFT JOIN (SELECT DISTINCT call_id FROM calls) c ON m.call_id = c.call_id LEFT JOIN results ON m.call_id = results.call_id
"""
