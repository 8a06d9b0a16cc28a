"""Queries over the kept indexes of texts and vectors, and the whole recall ranker on top of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import retrieval as R
from lodewell.operators import text_index as X
from lodewell.operators import vector_index as V
from lodewell.operators.graph import NODES_SENT, cut, shared_dir
from lodewell.plans import recall as P
from lodewell.queries.recall import _BM25, _KNN, _RANKS, lexical, semantic
from lodewell.sources.tables import NOTES_SQL, notes, table, vectors

#: What a search by exact words, fields weighed 3, 2 and 1, gives over the table `kept`.
_EXACT = """words AS (
  SELECT doc_id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS t, regexp_extract_all(lower(array_to_string(tags, ' ')), '[\\p{L}\\p{N}]+') AS g, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS c FROM kept
), q AS (SELECT unnest(['the', 'of', 'en']) AS term), tf AS (
  SELECT doc_id, term, len(list_filter(t, lambda w: w = term)) AS tf_t, len(t) AS len_t, len(list_filter(g, lambda w: w = term)) AS tf_g, len(g) AS len_g, len(list_filter(c, lambda w: w = term)) AS tf_c, len(c) AS len_c FROM words, q
), stats AS (
  SELECT term, count(*) AS n, avg(len_t) AS mean_t, avg(len_g) AS mean_g, avg(len_c) AS mean_c, count(*) FILTER (WHERE tf_t > 0) AS df_t, count(*) FILTER (WHERE tf_g > 0) AS df_g, count(*) FILTER (WHERE tf_c > 0) AS df_c FROM tf GROUP BY term
), found AS (
  SELECT doc_id, round(sum(
    coalesce(3.0 * ln(1 + (n - df_t + 0.5) / (df_t + 0.5)) * tf_t * 2.2 / (tf_t + 1.2 * (0.25 + 0.75 * len_t / mean_t)), 0) +
    coalesce(2.0 * ln(1 + (n - df_g + 0.5) / (df_g + 0.5)) * tf_g * 2.2 / (tf_g + 1.2 * (0.25 + 0.75 * len_g / mean_g)), 0) +
    coalesce(1.0 * ln(1 + (n - df_c + 0.5) / (df_c + 0.5)) * tf_c * 2.2 / (tf_c + 1.2 * (0.25 + 0.75 * len_c / mean_c)), 0)), 6) AS score
  FROM tf JOIN stats USING (term) GROUP BY doc_id HAVING sum(tf_t + tf_g + tf_c) > 0
)"""
FIELDS = ["title", "tags", "content"]


def _changed(spark, sf_dir):
    """An index that went through changes: a third of the notes first had their titles alone, a quarter are deleted, and what was is merged in between."""
    path = f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
    rows = notes(spark, sf_dir).select("doc_id", *FIELDS)
    early = F.when(F.col("doc_id") % 3 == 0, F.col("title")).otherwise(F.col("content"))
    X.apply(spark, path, rows.withColumn("content", early), "doc_id", FIELDS)
    X.apply(spark, path, rows.where("doc_id % 3 = 0"), "doc_id")
    X.compact(spark, path)
    X.apply(spark, path, rows.where("doc_id % 4 = 1").withColumn("deleted", F.lit(True)), "doc_id")
    return path


@register("text_index_after_changes", f"WITH {NOTES_SQL}, kept AS (SELECT * FROM notes WHERE doc_id % 4 <> 1), {_EXACT} SELECT doc_id, score FROM found ORDER BY score DESC, doc_id LIMIT 25")
def text_index_after_changes(spark, sf_dir):
    found = X.top(spark, _changed(spark, sf_dir), ["the", "of", "en"], 200).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(25)


@register(
    "vector_index_exact",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS query, CAST(least(10, count(*)) AS BIGINT) AS near, arg_max(b.vec_id, list_cosine_similarity(a.e, b.e)) AS nearest FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1""",
)
def vector_index_exact(spark, sf_dir):
    rows, path = vectors(spark, sf_dir), f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    found = V.search(spark, V.write_index(rows, path), rows.where("vec_id % 20 = 0"), 10, V.ALL)
    return found.groupBy("query").agg(F.count("*").alias("near"), F.min_by("vec_id", "place").alias("nearest"))


@register("vector_index_recall", "SELECT count(*) AS queries, CAST(10 * count(*) AS BIGINT) AS wanted, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, sf_dir):
    rows, path = vectors(spark, sf_dir), f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    asked = rows.where("vec_id % 20 = 0")
    V.write_index(rows, path)
    measured = V.recall(V.search(spark, path, asked, 10), V.search(spark, path, asked, 10, V.ALL))
    return measured.select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


#: Documents as memories, with what the ranker looks at.
_MEMORIES = """memories AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'note' ELSE 'memory' END AS type, CASE doc_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'conversation' END AS category, CASE doc_id % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'cold' END AS temperature,
         CASE doc_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS importance, CASE WHEN doc_id % 2 = 0 THEN heat END AS heat_score, CASE WHEN doc_id % 6 <> 0 THEN CAST('2024-01-01' AS DATE) + CAST(doc_id % 60 AS INTEGER) END AS last_accessed,
         ['[[n' || (doc_id % 10) || ']]'] AS related, content, 1.0 + doc_id % 9 AS validity_alpha, 1.0 + doc_id % 4 AS validity_beta FROM notes)"""


def memories(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda m, values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), (i % m).cast("int"))
    return notes(spark, sf_dir).select(
        "doc_id",
        F.when(i % 5 == 0, "note").otherwise("memory").alias("type"),
        pick(3, {0: "decision", 1: "conversation"}).alias("category"),
        pick(4, {0: "hot", 1: "cold"}).alias("temperature"),
        pick(7, {0: "critical", 1: "low", 2: "high"}).alias("importance"),
        F.when(i % 2 == 0, F.col("heat")).alias("heat_score"),
        F.when(i % 6 != 0, F.date_add(F.lit("2024-01-01"), (i % 60).cast("int"))).alias("last_accessed"),
        F.array(F.concat(F.lit("[[n"), (i % 10).cast("string"), F.lit("]]"))).alias("related"),
        "content",
        "title",
        (1.0 + i % 9).alias("validity_alpha"),
        (1.0 + i % 4).alias("validity_beta"),
    )


_ASSOCIATES = """baskets AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), pairs AS (
  SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS w FROM baskets a JOIN baskets b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


def associates(spark, sf_dir):
    """Of seeds (node) their (a, b, w): parts of one order with a seed, by how many orders have both. Orders without a seed are left out before any are paired."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")

    def of(seeds):
        own = cut(lines.join(F.broadcast(seeds.select(F.col("node").alias("l_partkey"))), "l_partkey", "left_semi").select("l_orderkey", F.col("l_partkey").alias("a")).distinct())
        sent = F.broadcast(own) if own.count() <= NODES_SENT else own
        both = lines.join(sent, "l_orderkey").where("a <> l_partkey").select("l_orderkey", "a", F.col("l_partkey").alias("b")).distinct()
        return both.groupBy("a", "b").agg(F.count("*").alias("w"))

    return of


@register(
    "memory_ranking",
    f"""WITH {_BM25}, {_KNN}, {_RANKS}, {_ASSOCIATES}, {_MEMORIES}, hits AS (
  SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, lexical, semantic, coalesce(1.0 / (60 + lexical), 0) + coalesce(1.0 / (60 + semantic), 0) AS score FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id ORDER BY score DESC, doc_id LIMIT 90
), linked AS (SELECT l_partkey AS doc_id, count(*) AS inbound FROM lineitem GROUP BY 1), m AS (
  SELECT doc_id, lexical, semantic, h.score, coalesce(category, 'observation') AS category, coalesce(temperature, 'warm') AS temperature, coalesce(importance, 'medium') AS importance, heat_score, last_accessed, related, content, validity_alpha / (validity_alpha + validity_beta) AS validity,
         coalesce(inbound, 0) AS inbound
  FROM hits h JOIN memories USING (doc_id) LEFT JOIN linked USING (doc_id) WHERE type = 'memory'
), f AS (
  SELECT *, CASE WHEN heat_score IS NOT NULL THEN 0.5 + least(greatest(heat_score, 0), 16) / 16.0 ELSE CASE temperature WHEN 'hot' THEN 1.5 WHEN 'cold' THEN 0.5 ELSE 1.0 END END
    * CASE importance WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.7 ELSE 1.0 END
    * CASE WHEN related[1] IN ('[[n3]]', '[[n7]]') THEN 2.0 ELSE 1.0 END
    * coalesce(1 / (1 + date_diff('day', last_accessed, DATE '2024-04-01') / CASE category WHEN 'conversation' THEN 7.0 WHEN 'decision' THEN 30.0 ELSE 14.0 END), 1.0)
    * least(1.5, 1 + 0.1 * (CAST(contains(lower(content), 'thing') AS INTEGER) + CAST(contains(lower(content), 'tion') AS INTEGER)))
    * CASE WHEN validity <= 0.6 THEN 0.5 ELSE 1.0 END * (1 + 0.15 * least(1.0, ln(1 + inbound) / ln(26))) * score AS base
  FROM m WHERE importance <> 'low' AND validity > 0.4
), seeds AS (SELECT doc_id FROM f ORDER BY base DESC, doc_id LIMIT 5), spread AS (
  SELECT b AS doc_id, round(max(1 + 0.2 * norm), 4) AS boost FROM (
    SELECT a, b, round(w / CAST(max(w) OVER (PARTITION BY a) AS DOUBLE), 3) AS norm, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS place FROM pairs WHERE a IN (SELECT doc_id FROM seeds))
  WHERE place <= 8 AND b NOT IN (SELECT doc_id FROM seeds) GROUP BY b)
SELECT doc_id, round(base * coalesce(boost, 1), 6) AS score, CAST(row_number() OVER (ORDER BY base * coalesce(boost, 1) DESC, doc_id) AS INTEGER) AS rank,
  CASE WHEN lexical IS NOT NULL AND semantic IS NOT NULL THEN 'lexical+semantic' WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'lexical' END || ' match' || CASE WHEN temperature <> 'cold' THEN '; ' || temperature ELSE '' END
  || CASE WHEN related[1] IN ('[[n3]]', '[[n7]]') THEN '; linked to context' ELSE '' END || CASE WHEN inbound > 0 THEN '; central (' || inbound || CASE WHEN inbound = 1 THEN ' link)' ELSE ' links)' END ELSE '' END
  || CASE WHEN coalesce(1 / (1 + date_diff('day', last_accessed, DATE '2024-04-01') / CASE category WHEN 'conversation' THEN 7.0 WHEN 'decision' THEN 30.0 ELSE 14.0 END), 1.0) >= 0.5 THEN '; recent' ELSE '' END
  || CASE WHEN validity <= 0.6 THEN '; stale (contradicted)' ELSE '' END || CASE WHEN boost > 1 THEN '; co-recalled with top matches' ELSE '' END AS reason
FROM f LEFT JOIN spread USING (doc_id)""",
)
def memory_ranking(spark, sf_dir):
    arms = {"lexical": R.ranked(lexical(spark, sf_dir), "doc_id", 50, "lexical"), "semantic": R.ranked(semantic(spark, sf_dir, 50), "doc_id", 50, "semantic")}
    hits = R.fused(arms, "doc_id").withColumnRenamed("fused", "score")
    inbound = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count("*").alias("inbound"))
    found = P.ranked_memories(
        hits, memories(spark, sf_dir), F.lit("2024-04-01").cast("date"), "doc_id", inbound, associates(spark, sf_dir), least_importance="medium", related_to=["n3", "n7"], context="A thing, a thing: the tion and", limit=30
    )
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank", "reason")


@register("memory_recall")
def memory_recall(spark, sf_dir):
    """The ranking, diversified: a sequential choice that SQL lacks, tested against a plain one."""
    hits = R.fused({"lexical": R.ranked(lexical(spark, sf_dir), "doc_id", 90, "lexical"), "semantic": R.ranked(semantic(spark, sf_dir, 90), "doc_id", 90, "semantic")}, "doc_id").withColumnRenamed("fused", "score")
    found = P.memory_recall(hits, memories(spark, sf_dir), F.lit("2024-04-01").cast("date"), "doc_id", limit=10, most_tokens=2000)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank", "place", F.length("content").alias("letters"))
