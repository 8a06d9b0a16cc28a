"""Code navigation over parts as symbols, brands as files, types as repositories, and lines as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.catalog import register
from lodewell.operators import codenav as C
from lodewell.operators import retrieval as R
from lodewell.operators import walks as W
from lodewell.sources.tables import table

#: A line's part calls the part that its order folds to; where the supplier's number is a multiple of 5 the call stays unresolved.
_CODE = """symbols AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS repo_id, p_brand AS relative_path, CASE WHEN p_partkey % 6 = 0 THEN 'class' ELSE 'function' END AS kind,
         p_size * 10 AS start_line, p_size * 10 + p_partkey % 37 AS end_line FROM part
), calls AS (
  SELECT l_partkey AS caller_id, p_type AS repo_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_orderkey % (SELECT max(p_partkey) + 1 FROM part) END AS callee_id FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


def symbols(spark, sf_dir):
    start = F.col("p_size") * 10
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("repo_id"), F.col("p_brand").alias("relative_path"), F.when(F.col("p_partkey") % 6 == 0, "class").otherwise("function").alias("kind"), start.alias("start_line"), (start + F.col("p_partkey") % 37).alias("end_line")
    )


def calls(spark, sf_dir):
    n = (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1
    repo = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("caller_id"), F.col("p_type").alias("repo_id"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_orderkey") % n).alias("callee_id"))
    return rows.join(repo, "caller_id")


@register("file_outline", f"WITH {_CODE} SELECT id, name, kind, start_line, end_line FROM symbols WHERE repo_id = 'ECONOMY' AND relative_path = 'Brand#2'")
def file_outline(spark, sf_dir):
    return C.outline(symbols(spark, sf_dir), "ECONOMY", "Brand#2").select("id", "name", "kind", "start_line", "end_line")


@register(
    "file_audit",
    f"""WITH {_CODE}, s AS (
  SELECT *, end_line - start_line + 1 AS loc, (SELECT count(*) FROM calls c WHERE c.callee_id = symbols.id) AS callers,
         (SELECT count(*) FROM calls c JOIN symbols o ON o.id = c.caller_id WHERE c.callee_id = symbols.id AND o.relative_path <> symbols.relative_path) AS external FROM symbols
), h AS (SELECT repo_id, relative_path, name, row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY loc DESC, start_line, id) AS place FROM s WHERE kind <> 'class' QUALIFY place <= 3)
SELECT repo_id, relative_path, count(*) AS symbols, sum(loc) AS loc, count(*) FILTER (WHERE external > 0) AS entry_points, sum(callers) AS callers,
       (SELECT string_agg(name, '|' ORDER BY place) FROM h WHERE h.repo_id = s.repo_id AND h.relative_path = s.relative_path) AS heaviest FROM s GROUP BY repo_id, relative_path""",
)
def file_audit(spark, sf_dir):
    return C.file_audit(symbols(spark, sf_dir), calls(spark, sf_dir), 3).withColumn("heaviest", F.array_join("heaviest", "|"))


@register(
    "file_edges",
    f"""WITH {_CODE} SELECT DISTINCT a.repo_id, a.relative_path AS src, b.relative_path AS dst FROM calls c JOIN symbols a ON a.id = c.caller_id JOIN symbols b ON b.id = c.callee_id
WHERE a.repo_id = b.repo_id AND a.relative_path <> b.relative_path""",
)
def file_edges(spark, sf_dir):
    return C.file_edges(symbols(spark, sf_dir), calls(spark, sf_dir))


@register(
    "symbol_full_context",
    f"""WITH {_CODE}, me AS (SELECT * FROM symbols WHERE id = 7)
SELECT id, name, (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT name FROM symbols WHERE id IN (SELECT caller_id FROM calls WHERE callee_id = 7) ORDER BY name, id LIMIT 5)) AS callers,
  (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT name FROM symbols WHERE id IN (SELECT callee_id FROM calls WHERE caller_id = 7) ORDER BY name, id LIMIT 5)) AS callees,
  (SELECT string_agg(s_name, '|' ORDER BY s_name) FROM (SELECT DISTINCT s_name FROM supplier WHERE s_nationkey = (SELECT p_size FROM part WHERE p_partkey = 7) % 25)) AS imports FROM me""",
)
def symbol_full_context(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    me = rows.where("id = 7").select("id", "name", "repo_id", "relative_path")
    nation = table(spark, sf_dir, "part").where("p_partkey = 7").select((F.col("p_size") % 25).alias("s_nationkey"), F.col("p_type").alias("repo_id"), F.col("p_brand").alias("relative_path"))
    imports = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("module")).join(F.broadcast(nation), "s_nationkey")
    found = C.full_context(me, rows, calls(spark, sf_dir), imports)
    return found.select("id", "name", *[F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c) for c in ("callers", "callees", "imports")])


@register(
    "breaking_changes",
    """WITH log AS (SELECT o_orderkey AS id, o_orderpriority AS relative_path, CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'sig_changed' END AS change_kind, o_orderdate AS captured_at FROM orders),
hits AS (SELECT * FROM log WHERE captured_at >= TIMESTAMP '1997-01-01' AND change_kind = 'removed' AND starts_with(relative_path, '1'))
SELECT id, relative_path, strftime(captured_at, '%Y-%m-%d') AS day, (SELECT count(*) > 200 FROM hits) AS truncated FROM hits ORDER BY captured_at DESC, id DESC LIMIT 200""",
)
def breaking_changes(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("relative_path"), F.when(F.col("o_orderstatus") == "F", "removed").otherwise("sig_changed").alias("change_kind"), F.col("o_orderdate").alias("captured_at"))
    found = C.changes_since(log, F.lit("1997-01-01").cast("timestamp_ntz"), "removed", "1")
    return found.select("id", "relative_path", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "truncated")


def _stats(spark, sf_dir):
    repos = table(spark, sf_dir, "part").select(F.col("p_type").alias("repo_id")).union(spark.range(1).select(F.lit("EMPTY").alias("repo_id"))).distinct()
    files = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("repo_id"), "p_brand").agg(F.max("p_retailprice").alias("indexed_at"))
    return C.code_stats(repos, files, symbols(spark, sf_dir), calls(spark, sf_dir))


_STATS = f"""{_CODE}, stats AS (
  SELECT r.repo_id, (SELECT count(*) FROM symbols s WHERE s.repo_id = r.repo_id) AS symbols, (SELECT count(DISTINCT relative_path) FROM symbols s WHERE s.repo_id = r.repo_id) AS files,
         (SELECT max(p_retailprice) FROM part WHERE p_type = r.repo_id) AS last_indexed_at, (SELECT count(*) FROM calls c WHERE c.repo_id = r.repo_id AND callee_id IS NOT NULL) AS resolved,
         (SELECT count(*) FROM calls c WHERE c.repo_id = r.repo_id AND callee_id IS NULL) AS unresolved
  FROM (SELECT DISTINCT p_type AS repo_id FROM part UNION SELECT 'EMPTY') r)"""


@register("code_stats", f"WITH {_STATS} SELECT * FROM stats")
def code_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@register("code_scan_totals", f"WITH {_STATS} SELECT count(*) AS repos, sum(files) AS files, sum(symbols) AS symbols, sum(resolved + unresolved) AS calls FROM stats WHERE files > 0")
def code_scan_totals(spark, sf_dir):
    return C.scan_totals(_stats(spark, sf_dir))


@register(
    "dominant_repo",
    "SELECT l_orderkey, p_type AS repo_id FROM (SELECT l_orderkey, p_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, p_type) AS place FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE place = 1",
)
def dominant_repo(spark, sf_dir):
    repo = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("repo_id"))
    return C.dominant_repo(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(repo, "l_partkey"), "l_orderkey")


@register(
    "repo_locality",
    """SELECT n_regionkey AS repo_id, c_mktsegment AS machine_id, max(c_acctbal) AS last_seen_at, (SELECT max(s_acctbal) FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey WHERE n.n_regionkey = nation.n_regionkey) AS last_indexed_at
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey, c_mktsegment""",
)
def repo_locality(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("repo_id"))
    paths = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("repo_id", F.col("c_mktsegment").alias("machine_id")).agg(F.max("c_acctbal").alias("last_seen_at"))
    files = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select("repo_id", F.col("s_acctbal").alias("indexed_at"))
    return C.locality(paths, files)


@register(
    "repo_identity",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN substring(md5(s_name), 1, 16) ELSE substring(sha1(s_name), 1, 16) END AS id FROM supplier",
)
def repo_identity(spark, sf_dir):
    origin = F.when(F.col("s_suppkey") % 6 == 0, "  ").when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" "), "s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.repo_identity(origin, F.md5("s_name")).alias("id"))


@register(
    "repo_registry",
    """WITH last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey) AS repo_id, CASE WHEN status IS NULL THEN c_name ELSE 'order-' || k END AS slug FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL OUTER JOIN last ON c_custkey = o_custkey
WHERE (c_custkey IS NOT NULL OR status = 'O') AND coalesce(status, '') <> 'F'""",
)
def repo_registry(spark, sf_dir):
    repos = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("slug"), F.col("c_name").alias("name"))
    action = F.when(F.col("o_orderstatus") == "F", "drop").when(F.col("o_orderstatus") == "O", "register").otherwise("rename")
    slug = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    actions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), action.alias("action"), slug.alias("slug"), slug.alias("name"), F.col("o_orderkey").alias("at"))
    return C.registry_after(repos, actions).select("repo_id", "slug")


@register(
    "symbol_projection",
    f"""WITH {_CODE}, into_me AS (SELECT DISTINCT callee_id AS id, caller_id AS other FROM calls WHERE callee_id IS NOT NULL), out_of AS (SELECT DISTINCT caller_id AS id, callee_id AS other FROM calls WHERE callee_id IS NOT NULL),
i AS (SELECT id, string_agg('- [[' || name || ']]', chr(10) ORDER BY name) AS callers FROM (SELECT into_me.id, s.name, row_number() OVER (PARTITION BY into_me.id ORDER BY s.name, s.id) AS place FROM into_me JOIN symbols s ON s.id = other) WHERE place <= 20 GROUP BY id),
o AS (SELECT id, string_agg('- [[' || name || ']]', chr(10) ORDER BY name) AS callees FROM (SELECT out_of.id, s.name, row_number() OVER (PARTITION BY out_of.id ORDER BY s.name, s.id) AS place FROM out_of JOIN symbols s ON s.id = other) WHERE place <= 20 GROUP BY id)
SELECT symbols.id, sha256('# ' || name || chr(10) || chr(10) || '`' || relative_path || '`' || chr(10) || chr(10) || '## Callers' || chr(10) || coalesce(callers, '- none') || chr(10) || chr(10) || '## Callees' || chr(10) || coalesce(callees, '- none') || chr(10)) AS hash
FROM symbols LEFT JOIN i ON i.id = symbols.id LEFT JOIN o ON o.id = symbols.id""",
)
def symbol_projection(spark, sf_dir):
    return C.projection(symbols(spark, sf_dir).withColumn("signature", F.col("relative_path")), calls(spark, sf_dir)).select("id", "hash")


#: What the index of these queries holds, and how its fields weigh.
SYMBOL_FIELDS = {"name": 3.0, "signature": 1.0, "docstring": 1.0}
_DOCS = """d AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS name, string_split(lower(p_type) || ' ' || lower(p_name), ' ') AS signature,
  regexp_extract_all(lower(p_brand || ' ' || p_name || ' of ' || p_type), '[a-z0-9]+') AS docstring FROM part), f AS (
  SELECT id, 'name' AS field, 3.0 AS weight, name AS w FROM d UNION ALL SELECT id, 'signature', 1.0, signature FROM d UNION ALL SELECT id, 'docstring', 1.0, docstring FROM d)"""


def _indexed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_name").alias("signature"), F.concat("p_brand", F.lit(" "), "p_name", F.lit(" of "), "p_type").alias("docstring"))
    path = R.index_path(spark)
    R.postings(rows, list(SYMBOL_FIELDS), "id", path, 8)
    return path


@register(
    "symbol_search",
    f"""WITH {_DOCS}, m AS (SELECT id, field, weight, len(w) AS len, len(list_filter(range(1, len(w)), lambda i: w[i] = 'red' AND starts_with(w[i + 1], 'wid'))) AS tf FROM f),
s AS (SELECT field, avg(len) AS mean, count(*) AS n, count(*) FILTER (WHERE tf > 0) AS df FROM m GROUP BY field)
SELECT id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM m JOIN s USING (field) WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def symbol_search(spark, sf_dir):
    """A phrase whose last word is a prefix, in names, signatures and docstrings."""
    found = R.search_postings(spark, _indexed(spark, sf_dir), "Red wid", SYMBOL_FIELDS, "id", phrase=True)
    return found.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@register(
    "indexed_bm25_topk",
    f"""WITH {_DOCS}, q AS (SELECT unnest(['blue', 'promo', 'gear']) AS term), m AS (SELECT id, field, weight, term, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, term))) AS tf FROM f, q),
s AS (SELECT field, term, avg(len) AS mean, count(*) AS n, count(*) FILTER (WHERE tf > 0) AS df FROM m GROUP BY field, term)
SELECT id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM m JOIN s USING (field, term) WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def indexed_bm25_topk(spark, sf_dir):
    found = R.search_postings(spark, _indexed(spark, sf_dir), "blue promo gear", SYMBOL_FIELDS, "id")
    return found.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


#: Two steps of a walk from symbol 1 with at most 40 nodes, level by level.
_WALK = """start AS (SELECT 1 AS node, 0 AS hops), one AS (SELECT DISTINCT {next} AS node FROM e WHERE {at} = 1 AND {next} <> 1 ORDER BY node LIMIT 39),
two AS (SELECT DISTINCT {next} AS node FROM e WHERE {at} IN (SELECT node FROM one) AND {next} <> 1 AND {next} NOT IN (SELECT node FROM one)),
seen AS (SELECT * FROM start UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two QUALIFY row_number() OVER (ORDER BY node) <= 39 - (SELECT count(*) FROM one))"""


@register("symbol_callers", f"WITH {_CODE}, e AS (SELECT caller_id, callee_id FROM calls WHERE callee_id IS NOT NULL), {_WALK.format(at='callee_id', next='caller_id')} SELECT node, hops FROM seen")
def symbol_callers(spark, sf_dir):
    return W.callers(calls(spark, sf_dir), 1, 2, 40)[0]


@register(
    "symbol_callees",
    f"""WITH {_CODE}, e AS (SELECT caller_id, callee_id FROM calls WHERE callee_id IS NOT NULL), {_WALK.format(at='caller_id', next='callee_id')}
SELECT 'node' AS kind, CAST(node AS VARCHAR) AS a, CAST(hops AS VARCHAR) AS b FROM seen UNION ALL SELECT DISTINCT 'edge', CAST(caller_id AS VARCHAR), CAST(callee_id AS VARCHAR) FROM e WHERE caller_id IN (SELECT node FROM seen WHERE hops < 2)
UNION ALL SELECT 'unresolved', 's' || l_suppkey, CAST(count(*) AS VARCHAR) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey = 1 AND l_suppkey % 5 = 0 GROUP BY l_suppkey""",
)
def symbol_callees(spark, sf_dir):
    n = (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_orderkey") % n).alias("callee_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("callee_name"))
    nodes, edges, unresolved = W.callees(rows, 1, 2, 40)
    told = lambda kind, t, a, b: t.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    return told("node", nodes, "node", "hops").union(told("edge", edges, "src", "dst")).union(told("unresolved", unresolved, "callee_name", "calls"))
