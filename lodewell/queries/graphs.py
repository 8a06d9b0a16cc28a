"""Graph queries: orders link customers; lines link suppliers; orders link parts; vectors link their neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import graph as G
from lodewell.sources.tables import table, vectors

#: customer -> number edges of a directed graph, one for each order; of four times as many numbers as there are customers, so most links lead to nobody.
_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, (o_custkey * 5 + o_orderkey * 3) % (SELECT 4 * max(c_custkey) + 1 FROM customer) AS dst FROM orders) WHERE src <> dst)"""


def edges(spark, sf_dir):
    n = 4 * (table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0) + 1
    dst = (F.col("o_custkey") * 5 + F.col("o_orderkey") * 3) % n
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), dst.alias("dst")).where("src <> dst").distinct()


def calls(spark, sf_dir):
    """Distinct (src, dst) of all lines: a supplier calls the one that the part's key folds to, over as many as there are keys."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    n = items.agg(F.max("l_suppkey")).first()[0] or 1
    return items.select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") % n + 1).cast("long").alias("dst")).where("src <> dst").distinct()


@register(
    "degree_stats",
    f"""WITH {_EDGES}, d AS (SELECT c_custkey AS node, (SELECT count(*) FROM edges WHERE dst = c_custkey) AS inbound, (SELECT count(*) FROM edges WHERE src = c_custkey) AS outbound FROM customer)
SELECT count(*) AS nodes, sum(inbound) AS links, round(avg(inbound), 4) AS mean, count(*) FILTER (WHERE inbound = 0 AND outbound = 0) AS orphans, max(inbound) AS most FROM d""",
)
def degree_stats(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    found = G.degrees(edges(spark, sf_dir), nodes).join(nodes, "node", "left_semi")
    return found.agg(F.count("*").alias("nodes"), F.sum("inbound").alias("links"), F.round(F.avg("inbound"), 4).alias("mean"), F.count_if((F.col("inbound") == 0) & (F.col("outbound") == 0)).alias("orphans"), F.max("inbound").alias("most"))


@register("orphan_listing", f"WITH {_EDGES} SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = c_custkey) ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def orphan_listing(spark, sf_dir):
    linked = edges(spark, sf_dir).select(F.col("dst").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(linked, "c_custkey", "left_anti").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)


@register(
    "bridge_nodes",
    """WITH o AS (SELECT DISTINCT l_suppkey, n_regionkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT l_suppkey, count(*) AS regions, string_agg(n_regionkey, ',' ORDER BY n_regionkey) AS names FROM o GROUP BY 1 HAVING count(*) >= 2""",
)
def bridge_nodes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    place = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_regionkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(place, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "n_regionkey")
    pairs = items.join(orders, "l_orderkey").select("l_suppkey", "n_regionkey").distinct()
    grouped = pairs.groupBy("l_suppkey").agg(F.count("*").alias("regions"), F.sort_array(F.collect_list("n_regionkey")).alias("names"))  # regions are five
    return grouped.where("regions >= 2").select("l_suppkey", "regions", F.array_join(F.transform("names", lambda n: n.cast("string")), ",").alias("names"))


@register(
    "khop_neighbourhood",
    f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 7 AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM w JOIN both_ways ON src = node WHERE hops < 3)
SELECT node, min(hops) AS hops FROM w GROUP BY node""",
)
def khop_neighbourhood(spark, sf_dir):
    seed = spark.range(1).select(F.lit(7).cast("long").alias("node"))
    return G.reach(G.both_ways(edges(spark, sf_dir)), seed, 3)


@register(
    "change_impact",
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 7 AS node, 0 AS hops UNION SELECT src, hops + 1 FROM w JOIN edges ON dst = node WHERE hops < 5)
SELECT node, min(hops) AS hops FROM w GROUP BY node HAVING min(hops) > 0""",
)
def change_impact(spark, sf_dir):
    return G.impact(edges(spark, sf_dir).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")), 7, 5).withColumn("node", F.col("node").cast("long"))


@register(
    "call_chain",
    f"""WITH RECURSIVE {_EDGES}, start AS (SELECT min(src) AS a FROM edges), w AS (SELECT a AS node, [a] AS path FROM start UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN edges ON src = node WHERE len(path) < 4 AND NOT list_contains(path, dst)),
best AS (SELECT node, path FROM w WHERE len(path) = 4 AND node NOT IN (SELECT node FROM w WHERE len(path) < 4)), target AS (SELECT max(node) AS t FROM best)
SELECT array_to_string(min(path), '>') AS path, 3 AS length FROM best, target WHERE node = t HAVING count(*) > 0""",
)
def call_chain(spark, sf_dir):
    rows = G.cut(edges(spark, sf_dir).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    start = rows.agg(F.min("src")).first()[0]
    if start is None:
        return spark.range(0).select(F.lit("").alias("path"), F.lit(0).alias("length"))
    seed = spark.range(1).select(F.lit(start).alias("node"))
    far = G.reach(rows, seed, 3).where("hops = 3").agg(F.max("node")).first()[0]
    found = G.call_chain(rows, start, far if far is not None else start, 3)
    return found.where("length = 3").select(F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"), "length")


@register(
    "connected_components",
    f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT DISTINCT src AS node, src AS root FROM both_ways UNION SELECT dst, root FROM w JOIN both_ways ON src = node WHERE dst > root)
SELECT component, count(*) AS size FROM (SELECT node, min(root) AS component FROM w GROUP BY node) GROUP BY component""",
)
def connected_components(spark, sf_dir):
    return G.components(edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))


@register(
    "import_cycles_scc",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src)
SELECT a.src AS node, min(a.dst) AS component, count(*) AS size FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) >= 2""",
)
def import_cycles_scc(spark, sf_dir):
    return G.strong_components(edges(spark, sf_dir)).select("node", "component", "size")


@register("personalised_pagerank")
def personalised_pagerank(spark, sf_dir):
    links = calls(spark, sf_dir)
    none = links.limit(0)
    graph = G.recall_graph(links, none, none.withColumn("score", F.lit(0.0)))
    seeds = spark.range(10).select((F.col("id") * 7).alias("node"))
    scores = G.personalised_pagerank(graph, seeds)
    return scores.select("node", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "node").limit(100)


@register(
    "customer_communities",
    """WITH e AS (SELECT o_custkey, count(*) AS w FROM orders GROUP BY 1)
SELECT count(*) AS communities, CAST(sum(w + 1) AS BIGINT) AS members, max(w + 1) AS largest, round(1 - sum((w / CAST((SELECT count(*) FROM orders) AS DOUBLE)) ** 2), 6) AS modularity FROM e""",
)
def customer_communities(spark, sf_dir):
    """Orders tied to their customers: stars, so what is best is known, and its modularity is a sum."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"), F.lit(1.0).alias("w"))
    found = G.communities(rows)
    size = found.groupBy("community").agg(F.count("*").alias("n"), F.max("modularity").alias("q"))
    return size.agg(F.count("*").alias("communities"), F.sum("n").alias("members"), F.max("n").alias("largest"), F.round(F.max("q"), 6).alias("modularity"))


@register("louvain_communities")
def louvain_communities(spark, sf_dir):
    rows = calls(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    found = G.communities(rows)
    return found.groupBy("community").agg(F.count("*").alias("size"), F.round(F.max("modularity"), 6).alias("modularity"))


@register(
    "recall_graph_weights",
    f"""WITH {_EDGES}, raw AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0 AS w FROM edges UNION ALL SELECT least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey), 0.7 FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT round(least(2.0, w), 2) AS w, count(*) AS edges FROM (SELECT src, dst, sum(w) AS w FROM raw GROUP BY 1, 2) GROUP BY 1""",
)
def recall_graph_weights(spark, sf_dir):
    links = edges(spark, sf_dir)
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    graph = G.recall_graph(links, mentions, links.limit(0).withColumn("score", F.lit(0.0)))
    return graph.where("src < dst").groupBy(F.round("w", 2).alias("w")).agg(F.count("*").alias("edges"))


@register(
    "co_recall_update",
    """WITH e AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS place FROM lineitem GROUP BY l_orderkey, l_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) <= 4)
SELECT w, count(*) AS pairs FROM (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS w FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2) GROUP BY w""",
)
def co_recall_update(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    events = items.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "l_partkey"))), lambda s: s["l_partkey"]).alias("paths"))  # an order has seven lines
    graph = G.co_recall(events, 4, 1 << 30)
    return graph.where("src < dst").groupBy(F.col("w").cast("long").alias("w")).agg(F.count("*").alias("pairs"))


@register(
    "taxonomy_rollup",
    "SELECT coalesce(r_name, 'all') AS wing, coalesce(n_name, 'all') AS room, count(c_custkey) AS drawers, count(*) FILTER (WHERE c_acctbal > 5000) AS hot FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)",
)
def taxonomy_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rolled = rows.rollup("r_name", "n_name").agg(F.count("*").alias("drawers"), F.count_if(F.col("c_acctbal") > 5000).alias("hot"))
    return rolled.select(F.coalesce("r_name", F.lit("all")).alias("wing"), F.coalesce("n_name", F.lit("all")).alias("room"), "drawers", "hot")


@register(
    "tunnels",
    "SELECT c_mktsegment AS room, count(DISTINCT n_regionkey) AS wings, count(*) AS drawers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) >= 2 ORDER BY drawers DESC, room LIMIT 20",
)
def tunnels(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("room")).agg(F.countDistinct("n_regionkey").alias("wings"), F.count("*").alias("drawers")).where("wings >= 2").orderBy(F.desc("drawers"), "room").limit(20)


#: The nearest neighbours of a searched vector, and the edge's weight where the two are synonyms.
@register(
    "synonym_edges",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS src, d.vec_id AS dst, round(list_dot_product(q.e, d.e), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, d.e), 6) DESC, d.vec_id) AS place FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT src, dst, score, CASE WHEN score >= 0.8 THEN round(0.5 * score, 4) END AS w FROM s WHERE place <= 8""",
)
def synonym_edges(spark, sf_dir):
    from lodewell.operators.retrieval import nearest_of_each

    rows = vectors(spark, sf_dir)
    near = nearest_of_each(rows, rows.where("vec_id % 20 = 0"), 8)
    return near.select(F.col("query").alias("src"), F.col("vec_id").alias("dst"), "score", F.when(F.col("score") >= G.SYNONYM, F.round(0.5 * F.col("score"), 4)).alias("w"))


@register(
    "graph_snapshot",
    f"""WITH {_EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), d AS (SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS inbound, (SELECT count(*) FROM edges WHERE src = node) AS outbound FROM n),
k AS (SELECT * FROM d ORDER BY inbound + outbound DESC, node LIMIT 800)
SELECT node, inbound, outbound, (SELECT count(*) FROM edges WHERE src = k.node AND dst IN (SELECT node FROM k)) AS shown FROM k""",
)
def graph_snapshot(spark, sf_dir):
    links = edges(spark, sf_dir)
    kept, inside = G.snapshot(links, links.limit(0).select(F.col("src").alias("node")))
    shown = inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("shown"))
    return kept.join(shown, "node", "left").select("node", "inbound", "outbound", F.coalesce("shown", F.lit(0).cast("long")).alias("shown"))


@register(
    "edge_replacement",
    f"""WITH {_EDGES}, after AS (SELECT src, dst FROM edges WHERE src % 10 <> 3 UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 10 = 3)
SELECT count(*) AS edges, sum(src) AS sources, sum(dst) AS targets FROM after""",
)
def edge_replacement(spark, sf_dir):
    changed = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("node"))
    after = G.replaced_edges(edges(spark, sf_dir), changed, changed.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")))
    return after.agg(F.count("*").alias("edges"), F.sum("src").alias("sources"), F.sum("dst").alias("targets"))


@register(
    "path_lengths",
    f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hops FROM edges WHERE src < 10 UNION SELECT seed, dst, hops + 1 FROM w JOIN both_ways ON src = node WHERE hops < 6)
SELECT hops, count(*) AS pairs FROM (SELECT seed, node, min(hops) AS hops FROM w GROUP BY 1, 2) WHERE hops > 0 GROUP BY hops""",
)
def path_lengths(spark, sf_dir):
    links = edges(spark, sf_dir)
    return G.path_lengths(links, links.where("src < 10").select(F.col("src").alias("node")), 6)


def _recall(spark, sf_dir):
    """Lines' links as a recall graph, its seeds, and the nodes that are notes: three suppliers in four."""
    links = calls(spark, sf_dir)
    none = links.limit(0)
    graph = G.recall_graph(links, none, none.withColumn("score", F.lit(0.0)))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node"))
    hits = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select(F.col("s_suppkey").cast("long").alias("node"), "s_acctbal")
    ranked = hits.select("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s_acctbal"), "node")).alias("lexical"))
    seeds = G.recall_seeds(graph, nodes.where("node IN (3, 5, 1000000007)"), ranked)
    return graph, seeds, nodes.where("node % 4 <> 1")


@register(
    "recall_seed_spread",
    """WITH RECURSIVE n AS (SELECT max(l_suppkey) AS n FROM lineitem), c AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT n FROM n) + 1 AS dst FROM lineitem), e AS (SELECT src, dst FROM c WHERE src <> dst UNION SELECT dst, src FROM c WHERE src <> dst),
s AS (SELECT node FROM (SELECT 3 AS node UNION SELECT 5 UNION SELECT s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)) WHERE node IN (SELECT src FROM e)),
w AS (SELECT node, 0 AS hops FROM s UNION SELECT dst, hops + 1 FROM w JOIN e ON src = node WHERE hops < 3), h AS (SELECT node, min(hops) AS hops FROM w GROUP BY node)
SELECT CAST(k AS INTEGER) AS hops, (SELECT count(*) FROM h JOIN supplier ON s_suppkey = node WHERE h.hops = k AND node % 4 <> 1) AS notes FROM range(1, 4) r(k)""",
)
def recall_seed_spread(spark, sf_dir):
    return G.seed_spread(*_recall(spark, sf_dir))


@register("recall_graph_arm")
def recall_graph_arm(spark, sf_dir):
    graph, seeds, found = _recall(spark, sf_dir)
    return G.graph_arm(graph, seeds, found, 40)


@register(
    "fact_neighbours",
    "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS entity, 'ordered' AS predicate, 'outgoing' AS direction FROM orders WHERE o_custkey = 7 UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'ordered', 'incoming' FROM orders WHERE o_orderkey = 7 AND o_custkey <> 7",
)
def fact_neighbours(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.lit("ordered").alias("predicate"), F.col("o_orderkey").cast("string").alias("object"))
    return G.fact_neighbours(facts, "CRM/people/7.md")
