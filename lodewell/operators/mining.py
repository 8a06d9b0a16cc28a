"""Text mining: exchanges from conversations, preferences, memories, entities and their registry, code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import text as T

#: Patterns of preferences by kind, and of memories by category.
PREFERENCES = [
    ("preference", r"(?i)\bI\s+prefer\s+(.{10,120}?)(?:\.|$|\n)"),
    ("preference", r"(?i)\bI\s+(?:really\s+)?like\s+(?:to\s+|using\s+|how\s+)?(.{10,120}?)(?:\.|$|\n)"),
    ("preference", r"(?i)\bI\s+(?:really\s+)?dislike\s+(.{10,120}?)(?:\.|$|\n)"),
    ("preference", r"(?i)\bI\s+always\s+(.{10,120}?)(?:\.|$|\n)"),
    ("preference", r"(?i)\bI\s+never\s+(.{10,120}?)(?:\.|$|\n)"),
    ("preference", r"(?i)\bmy\s+(?:preferred|favorite|go-to)\s+(?:\w+\s+)?(?:is|are)\s+(.{5,120}?)(?:\.|$|\n)"),
    ("preference", r"(?i)\bI\s+(?:tend\s+to|usually)\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\bwe\s+(?:should\s+)?always\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\bwe\s+(?:should\s+)?never\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\bthe\s+convention\s+is\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\bthe\s+standard\s+is\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\bour\s+(?:team|project|codebase|convention)\s+(?:uses?|requires?|follows?)\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\bthe\s+rule\s+(?:is|here)\s+(.{10,120}?)(?:\.|$|\n)"),
    ("convention", r"(?i)\b(?:best\s+practice|standard\s+practice)\s+(?:is\s+(?:to\s+)?)?(.{10,120}?)(?:\.|$|\n)"),
    ("pain_point", r"(?i)\b(.{5,60}?)\s+doesn'?t\s+work\s+well\b"),
    ("pain_point", r"(?i)\b(.{5,60}?)\s+is\s+(?:really\s+)?(?:frustrating|annoying|broken|unreliable|buggy|slow|painful)\b"),
    ("pain_point", r"(?i)\bfrustrated\s+(?:by|with)\s+(.{10,120}?)(?:\.|$|\n)"),
    ("pain_point", r"(?i)\bstruggling\s+with\s+(.{10,120}?)(?:\.|$|\n)"),
    ("pain_point", r"(?i)\bthe\s+(?:problem|issue|trouble)\s+(?:with|is)\s+(.{10,120}?)(?:\.|$|\n)"),
]
MEMORIES = [
    ("decision", r"(?i)\b(?:decided|went\s+with|chose|trade-?off|opted\s+for)\b"),
    ("decision", r"(?i)\b(?:decision\s+(?:was|is)|we(?:'ll|\s+will)\s+go\s+with)\b"),
    ("decision", r"(?i)\b(?:settled\s+on|picked|selecting|selected)\b"),
    ("preference", r"(?i)\bI\s+prefer\b"),
    ("preference", r"(?i)\bI\s+(?:always\s+)?(?:like|love|use)\b"),
    ("preference", r"(?i)\b(?:always\s+use|convention\s+is|my\s+go-?to)\b"),
    ("preference", r"(?i)\b(?:I\s+dislike|I\s+hate|I\s+avoid)\b"),
    ("preference", r"(?i)\b(?:prefer(?:red|s)?|preference)\b"),
    ("milestone", r"(?i)\b(?:shipped|launched|deployed)\b"),
    ("milestone", r"(?i)\b(?:finally\s+got|breakthrough|completed)\b"),
    ("milestone", r"(?i)\b(?:released|went\s+live|went\s+to\s+prod)\b"),
    ("milestone", r"(?i)\b(?:finished|accomplished|achieved|milestone)\b"),
    ("problem", r"(?i)\b(?:bug|crash(?:es|ed|ing)?|error)\b"),
    ("problem", r"(?i)\b(?:broken|failing|issue\s+with)\b"),
    ("problem", r"(?i)\b(?:problem|regression|outage)\b"),
    ("problem", r"(?i)\b(?:doesn'?t\s+work|can'?t\s+(?:find|load|connect|start))\b"),
    ("problem", r"(?i)\b(?:exception|stack\s*trace|segfault|panic)\b"),
    ("fact", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:is\s+a|are\s+a|works?\s+at|runs?\s+on)\b"),
    ("fact", r"(?i)\b(?:the\s+(?:API|URL|endpoint|port|version)\s+is)\b"),
    ("fact", r"(?i)\b(?:located\s+(?:at|in)|hosted\s+(?:on|at))\b"),
]


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, user_text, assistant_text): each user turn with the first assistant turn before the next user turn, if any.

    Conversations are short by nature; a window orders each one's turns.
    """
    by = Window.partitionBy(conv).orderBy(turn)
    group = F.sum((F.col("role") == "user").cast("int")).over(by)
    marked = turns.withColumn("_exchange", group).where("_exchange > 0")
    first = lambda role, col: F.min_by(F.when(F.col("role") == role, F.col(col)), F.when(F.col("role") == role, F.col(turn)))
    return marked.groupBy(conv, "_exchange").agg(first("user", turn).alias(turn), first("user", "text").alias("user_text"), first("assistant", "text").alias("assistant_text")).drop("_exchange")


def preferences(texts: DataFrame, key: list[str], text: str, least: int = 10) -> DataFrame:
    """(key, kind, phrase) of all preference patterns; a phrase counts once for a row, for the first pattern that has it."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda p: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"^[,;:\s]+|[,;:\s]+$", "").alias("phrase")))

    each = F.concat(*[found(kind, pattern) for kind, pattern in PREFERENCES])
    rows = texts.select(*key, F.posexplode(each).alias("pos", "f")).where(F.length("f.phrase") >= least)
    first = rows.groupBy(*key, F.lower("f.phrase").alias("_same")).agg(F.min_by("f", "pos").alias("f"))
    return first.select(*key, "f.kind", "f.phrase")


def memories(texts: DataFrame, key: list[str], text: str, most: int = 500) -> DataFrame:
    """(key, category, sentence): of each sentence the first category whose pattern matches; repeats of 100 letters count once."""
    rows = texts.select(*key, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))
    category = None
    for name, pattern in MEMORIES:
        hit = F.col("sentence").rlike(pattern)
        category = F.when(hit, name) if category is None else category.when(hit, name)
    rows = rows.withColumn("category", category).where("category IS NOT NULL").withColumn("sentence", F.substring("sentence", 1, most))
    same = F.lower(F.substring("sentence", 1, 100))
    return rows.groupBy(*key, "category", same.alias("_same")).agg(F.min_by("sentence", "pos").alias("sentence")).drop("_same")


def registry(found: DataFrame, at: str, tier: str = "detected") -> DataFrame:
    """One row for each normalised name and type: occurrences, first and last seen, and the tier that the caller gives them; `registry.merged` resolves aliases."""
    return found.groupBy(F.lower(T.squeezed(F.col("name"))).alias("name"), "type").agg(F.count("*").alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.lit(tier).alias("tier"))


def mention_edges(found: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(a, b, confidence, notes): pairs among the first entities of a note, 0.6 times the lesser confidence."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "name"))
    first = found.groupBy(key, "name").agg(F.max("confidence").alias("confidence")).withColumn("place", place).where(F.col("place") <= most)
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.name") < F.col("b.name")))
    return pairs.groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(F.round(0.6 * F.max(F.least("a.confidence", "b.confidence")), 4).alias("confidence"), F.count("*").alias("notes"))


def symbol_id(repo: Column, path: Column, name: Column, kind: Column, signature: Column) -> Column:
    """16 hex digits that stay while repository, path, name, kind and signature, but for white space, do."""
    normal = T.squeezed(F.coalesce(signature, F.lit("")))
    return F.substring(F.sha1(F.concat_ws("|", repo, path, name, kind, F.when(normal == "", "<no-sig>").otherwise(normal))), 1, 16)


def symbol_delta(before: DataFrame, after: DataFrame, key: list[str], signature: str) -> DataFrame:
    """(key, change): removed, or sig_changed; from two snapshots, by one full outer join."""
    a, b = before.select(*key, F.col(signature).alias("old")), after.select(*key, F.col(signature).alias("new"))
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "sig_changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).where("change IS NOT NULL")
