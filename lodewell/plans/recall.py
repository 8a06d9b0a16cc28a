"""Whole queries composed of operators: recall, staged context, maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import scoring as S
from lodewell.functions import text as T
from lodewell.operators import retrieval as R
from lodewell.operators.graph import cut
from lodewell.operators.relational import search_filter


def recall(
    notes: DataFrame,
    query: str,
    key: str = "doc_id",
    vectors: DataFrame | None = None,
    vector: list[float] | None = None,
    graph_scores: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    limit: int = 10,
    over: int = 3,
    **filters,
) -> DataFrame:
    """Ranked notes with the rank of each arm, why they were found, and their place after diversification.

    Filters hold before anything is cut. Each arm gives `over * limit * 5` rows; these few are all
    that is fused, boosted and diversified. Without a semantic or graph arm the others stand alone.
    """
    rows = search_filter(notes, **filters)
    depth = over * limit * 5
    terms = [w for w in query.lower().split() if w not in T.STOPWORDS]
    arms = {"lexical": R.ranked(R.bm25(rows, terms, {"title": 3.0, "content": 1.0}, key, fuzzy=True), key, depth, "lexical")}
    if vectors is not None and vector:
        arms["semantic"] = R.ranked(R.nearest(vectors, vector, depth, key), key, depth, "semantic")
    if graph_scores is not None:
        arms["graph"] = R.ranked(graph_scores.select(key, "score"), key, depth, "graph")
    hits = R.fused(arms, key)
    found = rows.join(F.broadcast(hits), key)  # depth rows of each arm at most
    boost = S.lookup(F.col("collection"), weights or {}, 1.0)
    for name, factor in {"heat": lambda c: S.heat_boost(c), "days": lambda c: S.recency(c, 30), "inbound": lambda c: S.centrality_boost(c)}.items():
        if name in notes.columns:
            boost = boost * factor(F.col(name))
    reason = F.concat_ws(" and ", *[F.when(F.col(a).isNotNull(), f"{a} match") for a in arms])
    found = found.withColumn("score", F.col("fused") * boost).withColumn("reason", reason).withColumn("tokens", T.content_tokens(F.concat_ws(" ", "title", T.snippet(F.col("content")))))
    best = R.mmr(found.withColumn("query", F.lit(query)), "query", key, limit)
    return found.drop("tokens").join(F.broadcast(best.select(key, "place")), key).orderBy("place")


#: The order of importance, the days after which recency halves where a category has none of its own, and what a note lacks.
IMPORTANCE = ["low", "medium", "high", "critical"]
DEFAULT_HALF_LIFE = 30
UNSAID = {"category": "observation", "temperature": "warm", "importance": "medium"}
#: Boosts of a related note, of a word of the context and their most, and how many of the best activate their associates.
RELATED, CONTEXT_STEP, CONTEXT_MOST, SEEDS, OVER = 2.0, 0.1, 1.5, 5, 3


def context_words(snippet: str) -> list[str]:
    """Words of a context, each once: lower-case letters and digits, four or more, no stop words."""
    import re

    words = (re.sub(r"[^a-z0-9]", "", w) for w in snippet.lower().split())
    return list(dict.fromkeys(w for w in words if len(w) > 3 and w not in T.STOPWORDS))


def ranked_memories(
    hits: DataFrame,
    notes: DataFrame,
    as_of: Column,
    key: str = "path",
    inbound: DataFrame | None = None,
    associates: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    categories: list[str] | None = None,
    temperature: str | None = None,
    least_importance: str | None = None,
    related_to: list[str] | None = None,
    context: str = "",
    limit: int = 10,
    weight: float = 0.2,
) -> DataFrame:
    """Memories among the best hits (key, score, lexical, semantic), re-ranked: key, score, factors, reason and rank, not diversified yet.

    Of the hits the first OVER * limit, by score and key, are looked at. Of these stay the notes
    (key, type, category, temperature, importance, heat_score, last_accessed, related, content,
    validity_alpha, validity_beta) that are memories, pass the filters, and aren't quarantined. The score
    is the hit's times heat, importance, relation, recency, context, validity and centrality (`inbound`:
    key, inbound); then what is associated (a, b, w) with the SEEDS best ones gains; `associates` may be a
    function that is given the seeds (node) and returns their rows alone. Missing fields weigh as UNSAID
    says; notes never read have no loss of recency.
    """
    first = hits.orderBy(F.desc("score"), key).limit(OVER * limit)
    said = {c: F.coalesce(c, F.lit(v)) for c, v in UNSAID.items()}
    rows = notes.where(F.col("type") == "memory").withColumns(said).join(F.broadcast(first), key)  # OVER * limit rows
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    if temperature:
        rows = rows.where(F.col("temperature") == temperature)
    if least_importance:
        rows = rows.where(F.array_position(F.array(*map(F.lit, IMPORTANCE)), F.col("importance")) > IMPORTANCE.index(least_importance))
    share = S.validity(F.coalesce("validity_alpha", F.lit(2.0)), F.coalesce("validity_beta", F.lit(1.0)))
    rows = rows.withColumn("validity", share).where(S.validity_state(F.col("validity")) != "quarantined")
    rows = rows.join(F.broadcast(inbound.join(F.broadcast(first.select(key)), key, "left_semi")), key, "left") if inbound is not None else rows.withColumn("inbound", F.lit(None).cast("long"))
    days = F.datediff(as_of, F.col("last_accessed"))
    wanted = F.array(*map(F.lit, related_to)) if related_to else F.array().cast("array<string>")
    bare = F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda r: F.regexp_replace(F.regexp_replace(r, r"^\[\[", ""), r"\]\]$", ""))
    words = F.lit(0)
    for w in context_words(context):
        words = words + F.coalesce(F.lower("content").contains(w), F.lit(False)).cast("int")
    factors = {
        "heat": F.coalesce(F.when(F.col("heat_score").isNotNull(), S.heat_boost(F.col("heat_score"))), S.lookup(F.col("temperature"), S.TEMPERATURE_BOOST, 1.0)),
        "worth": S.lookup(F.col("importance"), S.IMPORTANCE_BOOST, 1.0),
        "relation": F.when(F.arrays_overlap(bare, wanted), RELATED).otherwise(1.0),
        "recent": F.coalesce(S.recency(days, S.lookup(F.col("category"), S.HALF_LIFE, DEFAULT_HALF_LIFE)), F.lit(1.0)),
        "context": F.least(1 + CONTEXT_STEP * words, F.lit(CONTEXT_MOST)),
        "valid": S.validity_factor(F.col("validity")),
        "central": S.centrality_boost(F.coalesce("inbound", F.lit(0))) if inbound is not None else F.lit(1.0),
    }
    rows = rows.withColumns(factors)
    product = F.col("score")
    for name in factors:
        product = product * F.col(name)
    base = rows.withColumn("score", product)
    boost = None
    if associates is not None:
        seeds = base.orderBy(F.desc("score"), key).limit(SEEDS).select(F.col(key).alias("node"))
        if callable(associates):
            seeds = cut(seeds)
            associates = associates(seeds)
        boost = R.spread_activation(associates, seeds, weight).withColumnRenamed("node", key)
    base = base.join(F.broadcast(boost), key, "left").withColumn("together", F.coalesce("boost", F.lit(1.0))).drop("boost") if boost is not None else base.withColumn("together", F.lit(1.0))
    match = F.when(F.col("lexical").isNotNull() & F.col("semantic").isNotNull(), "lexical+semantic match").when(F.col("semantic").isNotNull(), "semantic match").otherwise("lexical match")
    links = F.coalesce("inbound", F.lit(0))
    reason = F.concat_ws(
        "; ",
        match,
        F.when(F.col("temperature").isin("hot", "warm"), F.col("temperature")),
        F.when(F.col("relation") > 1, "linked to context"),
        F.when(links > 0, F.concat(F.lit("central ("), links.cast("string"), F.when(links == 1, " link)").otherwise(" links)"))),
        F.when(F.col("recent") >= 0.5, "recent"),
        F.when(F.col("valid") < 1, "stale (contradicted)"),
        F.when(F.col("together") > 1, "co-recalled with top matches"),
    )
    scored = base.withColumn("score", F.col("score") * F.col("together")).withColumn("reason", reason)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # OVER * limit rows


def memory_recall(hits: DataFrame, notes: DataFrame, as_of: Column, key: str = "path", limit: int = 10, most_tokens: int | None = None, **settings) -> DataFrame:
    """`ranked_memories`, diversified: `limit` rows with their place, and with `most_tokens` their contents cut to what four characters a token allow."""
    found = ranked_memories(hits, notes, as_of, key, limit=limit, **settings)
    tokens = found.withColumn("query", F.lit("")).withColumn("tokens", T.content_tokens(F.concat_ws(" ", "title", T.snippet(F.col("content")))))
    best = R.mmr(tokens, "query", key, limit).select(key, "place")
    placed = found.join(F.broadcast(best), key)
    if most_tokens is None:
        return placed.orderBy("place")
    before = F.coalesce(F.sum(F.length("content")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(4 * most_tokens) - F.col("_before")
    cut = placed.withColumn("_before", before).where(left > 0)
    whole = F.coalesce(F.length("content"), F.lit(0)) <= left
    text = F.when(whole, F.col("content")).otherwise(F.concat(F.substring("content", F.lit(1), left.cast("int")), F.lit("\n... [truncated to fit token budget]")))
    return cut.withColumn("content", text).drop("_before").orderBy("place")


def similar(notes: DataFrame, note, key: str = "doc_id", limit: int = 5, least: float = 0.005, vectors: DataFrame | None = None) -> DataFrame:
    """Notes found by the first 500 characters of one, without its front matter and without itself; by both arms if `vectors` (key, embedding) has the note's.

    Less than ten characters find nothing; hits below `least` are none.
    """
    first = notes.where(F.col(key) == note).select(F.regexp_replace(F.substring("content", 1, 500), r"(?s)^---.*?---\s*", "").alias("text")).first()
    if first is None or len((first["text"] or "").strip()) < 10:
        return notes.limit(0)
    depth, others = limit + 5, notes.where(F.col(key) != note)
    terms = sorted({w for w in first["text"].lower().split() if len(w) > 3 and w not in T.STOPWORDS})[:12]
    arms = {"lexical": R.ranked(R.bm25(others, terms, {"title": 3.0, "content": 1.0}, key), key, depth, "lexical")}
    own = vectors.where(F.col(key) == note).select("embedding").first() if vectors is not None else None
    if own and own["embedding"]:
        arms["semantic"] = R.ranked(R.nearest(vectors.where(F.col(key) != note), list(own["embedding"]), depth, key), key, depth, "semantic")
    return R.fused(arms, key).where(F.col("fused") >= least).orderBy(F.desc("fused"), key).limit(limit)


def context_block(found: DataFrame, order: list[Column], picks: int = 5, letters: int = 160, most: int = 1200) -> DataFrame:
    """One row, `block`: titles and snippets of the first rows, cut at `most` characters."""
    top = found.orderBy(*order).limit(picks).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), T.snippet(F.col("content"), letters))
    joined = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))), lambda s: s["line"]), "\n").alias("block"))
    return joined.select(F.when(F.length("block") > most, F.concat(F.substring("block", 1, most - 3), F.lit("..."))).otherwise(F.col("block")).alias("block"))


def wake_up(notes: DataFrame, order: list[Column], identity: int = 180, overview: int = 900, detail: int = 2000) -> DataFrame:
    """(layer, doc_id, kept): collection counts, the five hottest of each collection, the fifteen best, each within its token budget."""
    from lodewell.operators.lifecycle import budget_cut

    counts = notes.groupBy("collection").agg(F.count("*").alias("n")).select(F.lit(0).alias("layer"), F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", "collection", F.col("n").cast("string")).alias("text"), (-F.col("n")).alias("at"))
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("heat"), "doc_id"))
    five = notes.withColumn("place", place).where("place <= 5").select(F.lit(1).alias("layer"), "doc_id", F.concat_ws(": ", "title", T.snippet(F.col("content"), 120)).alias("text"), (-F.col("heat")).cast("long").alias("at"))
    best = notes.orderBy(*order).limit(15).select(F.lit(2).alias("layer"), "doc_id", T.snippet(F.col("content"), 600).alias("text"), F.lit(0).cast("long").alias("at"))
    layers = [(counts, identity), (five, overview), (best, detail)]
    out = None
    for rows, tokens in layers:
        cut = budget_cut(rows, "layer", [F.col("at"), F.col("doc_id"), F.col("text")], "text", tokens).select("layer", "doc_id", "kept")
        out = cut if out is None else out.unionByName(cut)
    return out


def redacted(brief: DataFrame, text: str, audience: str) -> DataFrame:
    """Addresses and numbers of persons masked, unless the audience is the owner."""
    if audience == "owner":
        return brief
    masked = F.regexp_replace(F.regexp_replace(text, r"[\w.+-]+@[\w-]+\.[\w.]+", "[mail]"), r"\+?\d[\d ()-]{7,}\d", "[number]")
    return brief.withColumn(text, masked)
