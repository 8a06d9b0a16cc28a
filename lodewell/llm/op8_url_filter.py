"""URL filters: rules by host and path, and for the rest trust and distrust propagated over host links.

Pages whose rule allows them seed trust with their host, pages whose rule blocks them distrust, and
pages without a rule neutral mass. Trust and neutral mass follow the links between hosts
(personalised PageRank), distrust follows them backward: who links to blocked hosts is distrusted.
Links within a host are no edges, and a host without links of a direction keeps that mass.
A host whose share of distrust exceeds THRESHOLD is blocked where no rule says otherwise.

A null url, or one without `://`, has an empty host and path and is judged like any host's page.
A null html has no links. Hosts meet only as partial sums; the join of pages with their host's
verdict is salted, so a host may hold any share of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import discard, table, written

#: The rules of the contract, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
FOLLOW, THRESHOLD, ENOUGH, SALTS = 0.85, 0.5, 1e-6, 32
MASS = ["trust", "neutral", "distrust"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null where none fits."""
    rule = verdict = None
    for name, prefix, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the hrefs of pages with columns host and html."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), 1))
    found = pages.select(F.col("host").alias("src"), href.alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href")))
    return found.select("src", dst.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def host_steps(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, forward, backward): shares of a host's mass that go each way; a host without links of a direction keeps that mass.

    Every host has a step to itself, if only of share 0, so none is lost on the way.
    """
    out = links.groupBy("src").agg(F.sum("links").alias("total"))
    into = links.groupBy("dst").agg(F.sum("links").alias("total"))
    forward = links.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("forward"), F.lit(0.0).alias("backward"))
    backward = links.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("forward"), (F.col("links") / F.col("total")).alias("backward"))
    ends = lambda side, by: hosts.join(side.select(F.col(by).alias("host"), F.lit(0.0).alias("share")), "host", "left").select(F.col("host").alias("src"), F.coalesce("share", F.lit(1.0)).alias("share"))
    kept = ends(out, "src").withColumnRenamed("share", "forward").join(ends(into, "dst").withColumnRenamed("share", "backward"), "src")
    return forward.unionByName(backward).unionByName(kept.select("src", F.col("src").alias("dst"), "forward", "backward"))


def propagate(seeds: DataFrame, links: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """(host, trust, neutral, distrust) from seeds of the same columns, by power iteration; each round is written.

    Shares of steps add up to 1, so each round changes at most FOLLOW times as much as the one
    before: the loop ends, when a round moves no more than `enough` of all mass.
    """
    links = written(links, "host-links")
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    base = written(hosts.join(seeds, "host", "left").na.fill(0.0, MASS), "host-seeds")
    steps = written(host_steps(base.select("host"), links), "host-steps")
    discard(links)
    scaled = base.select("host", *[(F.col(n) * (1 - FOLLOW)).alias(n) for n in MASS])
    now, before = base, []
    while True:
        moved = steps.join(now.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(
            *[F.sum(F.col(n) * F.col("backward" if n == "distrust" else "forward") * FOLLOW).alias(n) for n in MASS]
        )
        following = written(scaled.unionByName(moved).groupBy("host").agg(*[F.sum(n).alias(n) for n in MASS]), "host-scores")
        old = now.select("host", *[F.col(n).alias("old_" + n) for n in MASS])
        change, mass = following.join(old, "host").agg(F.sum(sum(F.abs(F.col(n) - F.col("old_" + n)) for n in MASS)), F.sum(sum(F.col(n) for n in MASS))).first()
        for done in before:
            discard(done)
        now, before = following, [following]
        if (change or 0) <= enough * (mass or 0):
            return now


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust, neutral and distrust."""
    rules = RULES if rules is None else rules
    url = F.col("url").cast("string")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rule, says = by_rules(F.col("host"), F.col("path"), rules)
    named = named.select("*", rule.alias("rule"), says.alias("says"))
    one = lambda hit: F.sum(F.when(hit, 1.0).otherwise(0.0))
    seeds = named.groupBy("host").agg(one(F.col("says") == "allow").alias("trust"), one(F.col("says").isNull()).alias("neutral"), one(F.col("says") == "block").alias("distrust"))
    scores = propagate(written(seeds, "host-mass"), host_links(named.select("host", "html")))
    scores = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.drop("html").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    share = F.col("distrust") / (F.col("trust") + F.col("neutral") + F.col("distrust"))
    method = F.when(share > threshold, "block").otherwise("allow")
    return salted.join(scores, ["host", "salt"]).select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "trust", "neutral", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: Propagation as a recursion of 150 rounds, after which no more than 0.85^150 of the mass is left to move.
ORACLE_SQL = r"""
WITH RECURSIVE named AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages
), ruled AS (
  SELECT *, '.' || host AS h, CASE WHEN h LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN h LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                                   WHEN h LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN h LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM named
), judged AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says FROM ruled
), hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS href FROM named
), links AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(href, '(?s)^.*?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM hrefs)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), hosts AS (
  SELECT host, sum(coalesce(says = 'allow', false)::INT)::DOUBLE AS trust, sum((says IS NULL)::INT)::DOUBLE AS neutral, sum(coalesce(says = 'block', false)::INT)::DOUBLE AS distrust
  FROM judged GROUP BY host
), base AS (
  SELECT host, coalesce(trust, 0) AS trust, coalesce(neutral, 0) AS neutral, coalesce(distrust, 0) AS distrust FROM (SELECT host FROM hosts UNION SELECT src FROM links UNION SELECT dst FROM links) LEFT JOIN hosts USING (host)
), steps AS MATERIALIZED (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forward, 0.0::DOUBLE AS backward FROM links
  UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM links
  UNION ALL SELECT host, host, (host NOT IN (SELECT src FROM links))::INT::DOUBLE, (host NOT IN (SELECT dst FROM links))::INT::DOUBLE FROM base
), mass AS (
  SELECT 0 AS round, host, trust, neutral, distrust FROM base
  UNION ALL
  SELECT round + 1, dst, 0.15 * any_value(base.trust) + 0.85 * sum(mass.trust * forward), 0.15 * any_value(base.neutral) + 0.85 * sum(mass.neutral * forward),
         0.15 * any_value(base.distrust) + 0.85 * sum(mass.distrust * backward)
  FROM mass JOIN steps ON mass.host = src JOIN base ON base.host = dst WHERE round < 150 GROUP BY round, dst
)
SELECT page_id, judged.host AS host, path, rule, coalesce(says, CASE WHEN distrust / (trust + neutral + distrust) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN mass ON judged.host = mass.host AND round = 150
"""
