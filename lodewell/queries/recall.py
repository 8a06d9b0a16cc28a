"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.functions import scoring as S
from lodewell.functions import text as T
from lodewell.operators import retrieval as R
from lodewell.operators import shingles as N
from lodewell.sources.tables import NOTES_SQL, documents, notes, table, vectors

#: The literal search of these queries: words that begin so, in any field; and the vector of row 0.
TERMS = ["thing", "idiot", "unge"]
FIELDS = {"title": 3.0, "content": 1.0}
WEIGHTS = {"en": 1.2, "de": 1.0, "fr": 0.9, "es": 0.8}

_BM25 = f"""{NOTES_SQL}, words AS (
  SELECT doc_id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS t, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS c FROM notes
), q AS (SELECT unnest({TERMS}) AS term), tf AS (
  SELECT doc_id, term, len(list_filter(t, lambda w: starts_with(w, term))) AS tf_t, len(t) AS len_t, len(list_filter(c, lambda w: starts_with(w, term))) AS tf_c, len(c) AS len_c FROM words, q
), stats AS (
  SELECT term, count(*) AS n, avg(len_t) AS mean_t, avg(len_c) AS mean_c, count(*) FILTER (WHERE tf_t > 0) AS df_t, count(*) FILTER (WHERE tf_c > 0) AS df_c FROM tf GROUP BY term
), lex_arm AS (
  SELECT doc_id, round(sum(
    3.0 * ln(1 + (n - df_t + 0.5) / (df_t + 0.5)) * tf_t * 2.2 / (tf_t + 1.2 * (0.25 + 0.75 * len_t / mean_t)) +
    1.0 * ln(1 + (n - df_c + 0.5) / (df_c + 0.5)) * tf_c * 2.2 / (tf_c + 1.2 * (0.25 + 0.75 * len_c / mean_c))), 6) AS score
  FROM tf JOIN stats USING (term) GROUP BY doc_id HAVING sum(tf_t + tf_c) > 0
)"""
_KNN = """sem_arm AS (
  SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings
)"""
_RANKS = """lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical FROM lex_arm QUALIFY lexical <= 50),
sem AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS semantic FROM sem_arm QUALIFY semantic <= 50)"""


def lexical(spark, sf_dir):
    return R.bm25(notes(spark, sf_dir), TERMS, FIELDS, "doc_id").withColumn("score", F.round("score", 6))


def semantic(spark, sf_dir, k):
    rows = vectors(spark, sf_dir)
    first = rows.where("vec_id = 0").first()
    return R.nearest(rows, first["embedding"], k).withColumnRenamed("vec_id", "doc_id") if first else rows.select(F.col("vec_id").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)


@register("lexical_bm25_topk", f"WITH {_BM25} SELECT doc_id, score FROM lex_arm ORDER BY score DESC, doc_id LIMIT 20")
def lexical_bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(20)


@register("vector_knn_topk", f"WITH {_KNN} SELECT vec_id, score FROM sem_arm ORDER BY score DESC, vec_id LIMIT 20")
def vector_knn_topk(spark, sf_dir):
    return semantic(spark, sf_dir, 20).withColumnRenamed("doc_id", "vec_id")


@register(
    "hybrid_recall_topk",
    f"""WITH {_BM25}, {_KNN}, {_RANKS}, both_arms AS (
  SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, lexical, semantic, coalesce(1.0 / (60 + lexical), 0) + coalesce(1.0 / (60 + semantic), 0) AS fused
  FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id)
SELECT doc_id, path, CAST(lexical AS INTEGER) AS lexical, CAST(semantic AS INTEGER) AS semantic,
  round(fused * CASE collection WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.0 WHEN 'fr' THEN 0.9 WHEN 'es' THEN 0.8 ELSE 1.0 END, 6) AS score
FROM both_arms JOIN notes USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""",
)
def hybrid_recall_topk(spark, sf_dir):
    arms = {"lexical": R.ranked(lexical(spark, sf_dir), "doc_id", 50, "lexical"), "semantic": R.ranked(semantic(spark, sf_dir, 50), "doc_id", 50, "semantic")}
    hits = R.fused(arms, "doc_id")  # 100 rows at most
    found = notes(spark, sf_dir).select("doc_id", "path", "collection").join(F.broadcast(hits), "doc_id")
    boosted = F.round(F.col("fused") * S.lookup(F.col("collection"), WEIGHTS, 1.0), 6)
    return found.select("doc_id", "path", "lexical", "semantic", boosted.alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@register(
    "rrf_fusion_three_arm",
    f"""WITH {_BM25}, {_KNN}, {_RANKS}, gra AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (ORDER BY count(DISTINCT l_partkey) DESC, l_orderkey) AS graph FROM lineitem
  WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1) GROUP BY l_orderkey QUALIFY graph <= 50),
arms AS (SELECT doc_id, lexical, NULL AS semantic, NULL AS graph FROM lex UNION ALL SELECT doc_id, NULL, semantic, NULL FROM sem UNION ALL SELECT doc_id, NULL, NULL, graph FROM gra)
SELECT doc_id, CAST(min(lexical) AS INTEGER) AS lexical, CAST(min(semantic) AS INTEGER) AS semantic, CAST(min(graph) AS INTEGER) AS graph,
  round(coalesce(1.0 / (60 + min(lexical)), 0) + coalesce(1.0 / (60 + min(semantic)), 0) + coalesce(1.0 / (60 + min(graph)), 0), 6) AS fused
FROM arms GROUP BY doc_id ORDER BY fused DESC, doc_id LIMIT 25""",
)
def rrf_fusion_three_arm(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey")
    near = items.join(items.where("doc_id = 1").select("l_partkey").distinct(), "l_partkey", "left_semi").groupBy("doc_id").agg(F.countDistinct("l_partkey").alias("score"))
    arms = {
        "lexical": R.ranked(lexical(spark, sf_dir), "doc_id", 50, "lexical"),
        "semantic": R.ranked(semantic(spark, sf_dir, 50), "doc_id", 50, "semantic"),
        "graph": R.ranked(near, "doc_id", 50, "graph"),
    }
    return R.fused(arms, "doc_id").withColumn("fused", F.round("fused", 6)).orderBy(F.desc("fused"), "doc_id").limit(25)


@register(
    "recall_boost_product",
    f"""WITH {NOTES_SQL}, use AS (
  SELECT user_id AS doc_id, count(*) AS accesses, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS days,
         count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY user_id)
SELECT doc_id, round((0.5 + least(greatest(heat, 0), 16) / 16.0) * CASE doc_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.7 END
  * (1 / (1 + days / 30.0)) * CASE WHEN (2.0 + good) / (3 + good + bad) <= 0.4 THEN 0.0 WHEN (2.0 + good) / (3 + good + bad) <= 0.6 THEN 0.5 ELSE 1.0 END
  * (1 + 0.15 * least(1.0, ln(1 + accesses) / ln(26))), 6) AS boost
FROM notes JOIN use USING (doc_id)""",
)
def recall_boost_product(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    use = events.groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count("*").alias("accesses"),
        F.datediff(F.lit("2024-02-01").cast("date"), F.max("ts").cast("date")).alias("days"),
        F.count_if(F.col("event_type") != "error").alias("good"),
        F.count_if(F.col("event_type") == "error").alias("bad"),
    )
    rows = notes(spark, sf_dir).select("doc_id", "heat").join(use, "doc_id")
    importance = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (F.col("doc_id") % 4 + 1).cast("int"))
    boost = (
        S.heat_boost(F.col("heat"))
        * S.lookup(importance, S.IMPORTANCE_BOOST, 1.0)
        * S.recency(F.col("days"), 30)
        * S.validity_factor(S.validity(2 + F.col("good"), 1 + F.col("bad")))
        * S.centrality_boost(F.col("accesses"))
    )
    return rows.select("doc_id", F.round(boost, 6).alias("boost"))


@register(
    "two_bucket_recall",
    f"""WITH {_BM25}, marked AS (SELECT doc_id, score, CASE WHEN quality = 1 THEN 'memory' ELSE 'knowledge' END AS bucket FROM lex_arm LEFT JOIN labels USING (doc_id))
SELECT doc_id, score, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM marked QUALIFY place <= 10""",
)
def two_bucket_recall(spark, sf_dir):
    found = lexical(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.two_buckets(found, F.coalesce(F.col("quality") == 1, F.lit(False)), "doc_id", 10).select("doc_id", "score", "bucket", "place")


@register("mmr_diversify")
def mmr_diversify(spark, sf_dir):
    top = lexical(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(60)
    near = notes(spark, sf_dir).select("doc_id", T.content_tokens(F.concat_ws(" ", "title", T.snippet(F.col("content")))).alias("tokens")).join(F.broadcast(top), "doc_id")
    return R.mmr(near.withColumn("query", F.lit("q")), "query", "doc_id", 15).select("doc_id", F.round("score", 6).alias("score"), "place")


@register(
    "spreading_activation",
    """WITH baskets AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS w FROM baskets a JOIN baskets b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2),
normal AS (SELECT a, b, round(w / CAST(max(w) OVER (PARTITION BY a) AS DOUBLE), 3) AS norm, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS place FROM pairs WHERE a < 5)
SELECT b AS node, round(max(1 + 0.2 * norm), 4) AS boost FROM normal WHERE place <= 8 AND b >= 5 GROUP BY b""",
)
def spreading_activation(spark, sf_dir):
    baskets = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = baskets.where("l_partkey < 5").alias("a"), baskets.alias("b")  # the seeds' alone
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") != F.col("b.l_partkey"))).groupBy(F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b")).agg(F.count("*").alias("w"))
    seeds = spark.range(5).select(F.col("id").alias("node"))
    return R.spread_activation(pairs, seeds)


@register(
    "semantic_near_dup",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (
  SELECT a.vec_id AS query, b.vec_id, round(list_dot_product(a.e, b.e), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.vec_id) AS place FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query, vec_id AS nearest, score, score >= 0.92 AS duplicate FROM r WHERE place = 1""",
)
def semantic_near_dup(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    best = R.nearest_of_each(rows, rows.where("vec_id % 20 = 0"), 1)
    return best.select("query", F.col("vec_id").alias("nearest"), "score", (F.col("score") >= R.DUPLICATE).alias("duplicate"))


@register("leader_clusters")
def leader_clusters(spark, sf_dir):
    return R.leader_clusters(vectors(spark, sf_dir), "label", "vec_id", 0.25)


@register(
    "structural_near_dup",
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]{4}-[0-9]{2}-[0-9]{2}', ' date ', 'g'), '[0-9]{1,2}:[0-9]{2}', ' time ', 'g'), '[0-9]+', ' num ', 'g') AS s FROM documents),
w AS (SELECT doc_id, list_filter(regexp_extract_all(s, '[\p{L}\p{N}]+'), lambda x: len(x) >= 2 AND x NOT IN ('the', 'a', 'an', 'of', 'to', 'in', 'is', 'was', 'and')) AS w FROM t),
b AS (SELECT min(doc_id) AS doc_id, g FROM (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w) WHERE len(g) > 0 GROUP BY g),
p AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM b),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(shared / CAST(na + nb - shared AS DOUBLE), 4) AS jaccard FROM i WHERE shared / CAST(na + nb - shared AS DOUBLE) >= 0.85""",
)
def structural_near_dup(spark, sf_dir):
    items = N.structural_items(documents(spark, sf_dir), "doc_id", "text")
    return R.overlap_pairs(items, "doc_id", 0.85).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


@register("simhash_clusters")
def simhash_clusters(spark, sf_dir):
    from lodewell.operators import graph as G

    prints = G.cut(N.fingerprints(documents(spark, sf_dir), "doc_id", "text").where("simhash <> 0"))
    classes = G.components(R.hamming_pairs(prints, "doc_id").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # copies share a fingerprint: they belong to its representative's class
    least = prints.groupBy("simhash").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    rooted = least.join(classes, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    size = rooted.groupBy("cluster").agg(F.sum("n").alias("size")).where("size >= 2")
    return prints.join(rooted.join(size, "cluster").select("simhash", "cluster", "size"), "simhash").select("doc_id", "cluster", "size")


@register("signature_buckets", "SELECT regexp_replace(lower(trim(p_name)), '[a-z_]+', '_', 'g') || '/' || p_type AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) >= 2")
def signature_buckets(spark, sf_dir):
    key = F.concat(F.regexp_replace(F.lower(T.squeezed(F.col("p_name"))), "[a-z_]+", "_"), F.lit("/"), "p_type")
    return table(spark, sf_dir, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n >= 2")


@register(
    "title_levenshtein_pairs",
    """WITH n AS (SELECT DISTINCT p_brand, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part)
SELECT a.p_brand AS brand, a.slug AS a, b.slug AS b, levenshtein(a.slug, b.slug) AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.slug < b.slug WHERE levenshtein(a.slug, b.slug) < 3""",
)
def title_levenshtein_pairs(spark, sf_dir):
    return R.edit_pairs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), T.slug(F.col("p_name")).alias("slug")), "brand", "slug", 2)


@register(
    "arm_share",
    f"""WITH {_BM25}, {_KNN}, {_RANKS}, f AS (SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, coalesce(1.0 / (60 + lexical), 0) AS l, coalesce(1.0 / (60 + semantic), 0) AS s FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id)
SELECT round(sum(l) / sum(l + s), 4) AS lexical_share, round(sum(s) / sum(l + s), 4) AS semantic_share, count(*) FILTER (WHERE l > 0 AND s = 0) AS lexical_only,
  count(*) FILTER (WHERE s > 0 AND l = 0) AS semantic_only, count(*) FILTER (WHERE l > 0 AND s > 0) AS both_arms FROM f""",
)
def arm_share(spark, sf_dir):
    arms = {"lexical": R.ranked(lexical(spark, sf_dir), "doc_id", 50, "lexical"), "semantic": R.ranked(semantic(spark, sf_dir, 50), "doc_id", 50, "semantic")}
    part, other = S.rrf(F.col("lexical")), S.rrf(F.col("semantic"))
    return R.fused(arms, "doc_id").agg(
        F.round(F.sum(part) / F.sum("fused"), 4).alias("lexical_share"),
        F.round(F.sum(other) / F.sum("fused"), 4).alias("semantic_share"),
        F.count_if(F.col("semantic").isNull()).alias("lexical_only"),
        F.count_if(F.col("lexical").isNull()).alias("semantic_only"),
        F.count_if(F.col("lexical").isNotNull() & F.col("semantic").isNotNull()).alias("both_arms"),
    )


_QUERIES = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT q.vec_id AS query, q.label AS category, d.vec_id, CAST(d.label = q.label AS INTEGER) AS relevant,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, d.e), 6) DESC, d.vec_id) AS place FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)"""


@register(
    "quality_by_category",
    f"""WITH {_QUERIES}, m AS (SELECT query, any_value(category) AS category, sum(relevant) FILTER (WHERE place <= 10) AS hits, sum(relevant) AS total,
  sum(CASE WHEN relevant = 1 AND place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN place <= least(10, t) THEN 1 / log2(place + 1) ELSE 0 END) AS ideal
  FROM (SELECT *, sum(relevant) OVER (PARTITION BY query) AS t FROM r) GROUP BY query)
SELECT coalesce(CAST(category AS VARCHAR), 'all') AS category, count(*) AS queries, round(avg(hits / total), 4) AS recall_10, round(avg(hits / 10.0), 4) AS precision_10, round(avg(dcg / ideal), 4) AS ndcg_10, count(*) FILTER (WHERE hits = 0) AS zero_recall
FROM m WHERE total > 0 GROUP BY GROUPING SETS ((category), ())""",
)
def quality_by_category(spark, sf_dir):
    """Every twentieth vector as a query against all; what has its label is relevant."""
    rows = vectors(spark, sf_dir)
    queries = rows.where("vec_id % 20 = 0")
    top = R.nearest_of_each(rows, queries, 10).withColumn("relevant", (F.col("label") == F.col("category")).cast("int"))
    total = rows.groupBy(F.col("label").alias("category")).agg((F.count("*") - 1).alias("total"))  # all of the label but the query
    top = top.join(total, "category")
    gain = 1 / F.log2(F.col("place") + 1)
    by_query = top.groupBy("query").agg(
        F.first("category").alias("category"),
        F.sum("relevant").alias("hits"),
        F.first("total").alias("total"),
        F.sum(F.when(F.col("relevant") == 1, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("place") <= F.col("total"), gain).otherwise(0.0)).alias("ideal"),
    )
    rolled = by_query.where("total > 0").rollup("category").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("hits") / F.col("total")), 4).alias("recall_10"),
        F.round(F.avg(F.col("hits") / 10), 4).alias("precision_10"),
        F.round(F.avg(F.col("dcg") / F.col("ideal")), 4).alias("ndcg_10"),
        F.count_if(F.col("hits") == 0).alias("zero_recall"),
    )
    return rolled.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("all")))


@register(
    "reciprocal_rank",
    f"WITH {_QUERIES.replace(' WHERE q.vec_id % 20 = 0', '')} SELECT query, min(place) AS first_relevant, round(1.0 / min(place), 6) AS reciprocal_rank FROM r WHERE relevant = 1 GROUP BY query",
)
def reciprocal_rank(spark, sf_dir):
    """Every vector as a query against all others."""
    rows = vectors(spark, sf_dir)
    place = R.first_relevant(rows, rows)
    return place.select("query", F.col("place").alias("first_relevant"), F.round(1.0 / F.col("place"), 6).alias("reciprocal_rank"))


@register(
    "rescue_at_k",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recent FROM orders)
SELECT o_custkey, min(place) FILTER (WHERE recent = 1) AS current_place, min(place) FILTER (WHERE recent = 2) AS old_place,
  coalesce(min(place) FILTER (WHERE recent = 1) <= 5 AND (min(place) FILTER (WHERE recent = 2) IS NULL OR min(place) FILTER (WHERE recent = 2) > min(place) FILTER (WHERE recent = 1)), false) AS rescued
FROM o GROUP BY o_custkey""",
)
def rescue_at_k(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    by = Window.partitionBy("o_custkey")
    ranked = orders.withColumn("place", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")).withColumn("recent", F.row_number().over(by.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    places = ranked.groupBy("o_custkey").agg(F.min(F.when(F.col("recent") == 1, F.col("place"))).alias("current_place"), F.min(F.when(F.col("recent") == 2, F.col("place"))).alias("old_place"))
    rescued = (F.col("current_place") <= 5) & (F.col("old_place").isNull() | (F.col("old_place") > F.col("current_place")))
    return places.withColumn("rescued", F.coalesce(rescued, F.lit(False)))
