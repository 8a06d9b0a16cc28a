"""Filters, joins and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.functions import text as T
from lodewell.operators import relational as R
from lodewell.sources.tables import NOTES_SQL, notes, table


@register(
    "filter_conjunction",
    f"WITH {NOTES_SQL} SELECT doc_id, path, heat FROM notes JOIN labels USING (doc_id) WHERE collection IN ('en', 'fr') AND (starts_with(path, 'en/src1') OR starts_with(path, 'fr/')) AND heat >= 5 AND list_has_any(tags, ['src1', 'src2', 'src3']) AND quality = 1",
)
def filter_conjunction(spark, sf_dir):
    rows = notes(spark, sf_dir).select("doc_id", "path", "heat", "collection", "tags").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    found = R.search_filter(rows, collections=["en", "fr"], prefixes=["en/src1", "fr/"], tags=["src1", "src2", "src3"], least_heat=5).where("quality = 1")
    return found.select("doc_id", "path", "heat")


@register(
    "collection_classify",
    """SELECT CASE WHEN regexp_matches(url, '://blog\\.') THEN 'blog' WHEN regexp_matches(url, '://m\\.') THEN 'mobile' WHEN regexp_matches(url, '\\.example\\.net/') THEN 'net' ELSE 'general' END AS collection, count(*) AS n FROM pages GROUP BY 1""",
)
def collection_classify(spark, sf_dir):
    rules = [(r"://blog\.", "blog"), (r"://m\.", "mobile"), (r"\.example\.net/", "net")]
    return table(spark, sf_dir, "pages").groupBy(R.first_match(F.col("url"), rules, "general").alias("collection")).agg(F.count("*").alias("n"))


@register(
    "paginated_listing",
    """SELECT doc_id, n_chars, CAST(place AS INTEGER) AS place, (SELECT count(*) > 45 FROM documents WHERE lang = 'en') AS has_more
FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE lang = 'en') WHERE place > 20 AND place <= 45""",
)
def paginated_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    return R.page_of(rows, [F.desc("n_chars"), F.col("doc_id")], 20, 25)


_LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


@register(
    "link_resolution",
    f"""WITH {_LINKS}, paths AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || '.md' AS path FROM pages), base AS (
  SELECT regexp_replace(string_split(path, '/')[-1], '\\.md$', '') AS base, min(path) AS path FROM paths GROUP BY 1), t AS (
  SELECT page_id, href, regexp_replace(href, '^/+|/+$', '', 'g') AS target FROM links)
SELECT t.page_id, t.target, coalesce(p.path, base.path) AS resolved FROM t LEFT JOIN (SELECT DISTINCT path FROM paths) p ON p.path = t.target || '.md' LEFT JOIN base ON base.base = string_split(t.target, '/')[-1]""",
)
def link_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    paths = pages.select(F.concat(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit(".md")).alias("path")).distinct()
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).select("page_id", F.regexp_replace("href", "^/+|/+$", "").alias("target"))
    return R.resolve_links(links, paths)


@register(
    "broken_links",
    f"""WITH {_LINKS} SELECT page_id, count(*) AS broken, min(href) AS first FROM links WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = links.href) GROUP BY page_id ORDER BY broken DESC, page_id LIMIT 20""",
)
def broken_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    broken = R.unmatched(links, pages.select(F.col("url").alias("href")), "href")
    return broken.groupBy("page_id").agg(F.count("*").alias("broken"), F.min("href").alias("first")).orderBy(F.desc("broken"), "page_id").limit(20)


@register(
    "dead_nodes_anti_join",
    "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND NOT regexp_matches(p_name, '^(main|test)')",
)
def dead_nodes_anti_join(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.unmatched(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey").where(~F.col("p_name").rlike("^(main|test)"))


@register(
    "caller_counts",
    """SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS calls, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS callees,
  (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = s_suppkey AND o_orderstatus <> 'F') AS external_calls FROM supplier""",
)
def caller_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    counted = items.join(status, "l_orderkey", "left").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").alias("calls"), F.countDistinct("l_partkey").alias("callees"), F.count_if(F.col("o_orderstatus") != "F").alias("external_calls")
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(counted, "s_suppkey", "left").na.fill(0)


@register(
    "unique_match_resolution",
    """WITH one AS (SELECT p_name, p_brand, min(p_partkey) AS target FROM part GROUP BY 1, 2 HAVING count(*) = 1)
SELECT p.p_partkey, target FROM part p LEFT JOIN one ON one.p_name = p.p_name AND one.p_brand = 'Brand#' || (p.p_partkey % 25 + 1)""",
)
def unique_match_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    calls = part.select("p_partkey", "p_name", F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")).alias("p_brand"))
    return R.unique_resolution(calls, part.select("p_name", "p_brand", F.col("p_partkey").alias("target")), ["p_name", "p_brand"], "target").select("p_partkey", "target")


@register(
    "longest_prefix_match",
    """WITH prefixes AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS prefix FROM pages WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]*/[a-z]+/)', 1) FROM pages WHERE page_id % 5 = 0)
SELECT page_id, url, (SELECT max_by(prefix, length(prefix)) FROM prefixes WHERE starts_with(url, prefix) AND prefix <> '') AS prefix FROM pages""",
)
def longest_prefix_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.where("page_id % 3 = 0").select(F.regexp_extract("url", "^([a-z]+://[^/]*)", 1).alias("prefix"))
    sections = pages.where("page_id % 5 = 0").select(F.regexp_extract("url", "^([a-z]+://[^/]*/[a-z]+/)", 1).alias("prefix"))
    return R.longest_prefix(pages, "url", hosts.union(sections).where("prefix <> ''").distinct(), "prefix")


@register(
    "shared_tag_pairs",
    """WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared FROM t a JOIN t b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def shared_tag_pairs(spark, sf_dir):
    return R.shared_item_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


@register(
    "drifted_refs",
    """SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN md5(a.text) <> md5(b.text) THEN 'changed' ELSE 'same' END AS state
FROM (SELECT doc_id, text FROM documents) a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) b USING (doc_id)""",
)
def drifted_refs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = docs.select("doc_id", F.md5("text").alias("kept"))
    now = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"))
    return R.drifted(kept, now, "doc_id", "kept", "now").select("doc_id", "state")


@register(
    "snapshot_sync_plan",
    """WITH old AS (SELECT p_partkey, md5(p_name || p_type) AS h FROM part WHERE p_partkey % 10 <> 1), new AS (SELECT p_partkey, md5(p_name || CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE '' END || p_type) AS h FROM part WHERE p_partkey % 10 <> 2)
SELECT CASE WHEN old.p_partkey IS NULL THEN 'added' WHEN new.p_partkey IS NULL THEN 'removed' WHEN old.h <> new.h THEN 'changed' ELSE 'same' END AS action, count(*) AS n FROM old FULL OUTER JOIN new USING (p_partkey) GROUP BY 1""",
)
def snapshot_sync_plan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 10 <> 1").select("p_partkey", F.md5(F.concat("p_name", "p_type")).alias("h"))
    new = part.where("p_partkey % 10 <> 2").select("p_partkey", F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 6 == 0, "x").otherwise(""), "p_type")).alias("h"))
    return R.sync_plan(old, new, "p_partkey", "h").groupBy("action").agg(F.count("*").alias("n"))


@register(
    "keyed_upsert",
    """WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders), l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM v GROUP BY 1)
SELECT o_custkey, o_orderkey, o_totalprice FROM v JOIN l USING (o_custkey, o_orderkey) WHERE o_orderstatus <> 'F'""",
)
def keyed_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    first, later = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    marked = lambda rows: rows.withColumn("deleted", F.col("o_orderstatus") == "F")
    return R.upsert(marked(first).drop("deleted").limit(0), marked(first).unionByName(marked(later)), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@register(
    "nested_children",
    """SELECT n_nationkey, n_name, coalesce(string_agg(c_name, '|' ORDER BY c_name), '') AS children, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def nested_children(spark, sf_dir):
    found = R.nested(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", ["c_name"])
    names = F.transform("children", lambda c: c["c_name"])
    return found.select("n_nationkey", "n_name", F.coalesce(F.array_join(names, "|"), F.lit("")).alias("children"), F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@register(
    "union_distinct_sets",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def union_distinct_sets(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).distinct()
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")).distinct()
    # one shuffle tells all four
    sides = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = sides.agg(F.count("*").alias("union"), F.sum(F.col("a") + F.col("b")).alias("union_all"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("intersect"), F.count_if(F.col("b") == 0).alias("except"))
    return counts.unpivot([], ["union", "union_all", "intersect", "except"], "op", "n")


@register(
    "escaped_like_search",
    """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' ESCAPE '!' OR p_type LIKE '%100!%%' ESCAPE '!' OR p_brand LIKE '%d#1!_%' ESCAPE '!' ORDER BY p_partkey DESC LIMIT 50""",
)
def escaped_like_search(spark, sf_dir):
    like = lambda c, needle: F.expr(f"{c} LIKE '%{T.like_escaped(needle)}%' ESCAPE '!'")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return part.where(like("p_name", "red") | like("p_type", "100%") | like("p_brand", "d#1_")).select("p_partkey", "p_name").orderBy(F.desc("p_partkey")).limit(50)


@register(
    "allowlisted_paths",
    f"WITH {NOTES_SQL} SELECT doc_id, path FROM notes WHERE NOT list_contains(string_split(path, '/'), 'src3') AND (regexp_matches(path, '^en/[^/]*/[^/]*1\\.md$') OR regexp_matches(path, '^(.*/)?src7/[^/]*$'))",
)
def allowlisted_paths(spark, sf_dir):
    return R.allowlist(notes(spark, sf_dir).select("doc_id", "path"), ["src3"], ["en/*/*1.md", "**/src7/*"])
