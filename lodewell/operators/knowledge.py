"""Knowledge-graph building, ingest snapshots, task and preference keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators.codenav import CONTAINERS


def bootstrap(notes: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, object, confidence) of notes: their collection, links (0.8) and tags, and mentions (path, name, type, confidence)."""
    subject = F.col("path")
    one = lambda predicate, value, confidence: F.struct(F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(confidence).alias("confidence"))
    own = F.array(one("in_collection", F.col("collection"), 1.0))
    linked = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda t: one("links_to", t, 0.8))
    tagged = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: one("tagged", t, 1.0))
    rows = notes.select(subject.alias("subject"), F.explode(F.concat(own, linked, tagged)).alias("t")).select("subject", "t.*")
    if mentions is not None:
        rows = rows.unionByName(mentions.select(F.col("path").alias("subject"), F.concat(F.lit("mentions_"), "type").alias("predicate"), F.col("name").alias("object"), "confidence"))
    return rows.where("object IS NOT NULL").groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))


def linked_entities(pairs: DataFrame) -> DataFrame:
    """Triples that tie people to organisations and projects, from rows (person, organisation, project)."""
    facts = F.array(
        F.struct(F.col("person").alias("subject"), F.lit("works_at").alias("predicate"), F.col("organisation").alias("object")),
        F.struct(F.col("person").alias("subject"), F.lit("contributes_to").alias("predicate"), F.col("project").alias("object")),
        F.struct(F.col("project").alias("subject"), F.lit("owned_by").alias("predicate"), F.col("organisation").alias("object")),
    )
    return pairs.select(F.explode(facts).alias("t")).select("t.*").where("subject IS NOT NULL AND object IS NOT NULL").distinct()


def ingest(payloads: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The four code tables' new rows from payloads (repo_id, files: array of structs); files whose hash is known are left out.

    `files` has repo_id, relative_path and content_hash of what is there.
    """
    each = payloads.select("repo_id", F.explode("files").alias("f")).select("repo_id", "f.*")
    known = files.select("repo_id", "relative_path", "content_hash")
    fresh = each.join(known, ["repo_id", "relative_path", "content_hash"], "left_anti")
    out = {"files": fresh.drop("symbols", "calls", "imports")}
    for name in ("symbols", "calls", "imports"):
        if name in fresh.columns:
            out[name] = fresh.select("repo_id", "relative_path", F.explode(name).alias("x")).select("repo_id", "relative_path", "x.*")
    return out


def pull(files: DataFrame, symbols: DataFrame, since) -> DataFrame:
    """Files indexed at or after the watermark, with their symbols as a sorted array; a file's symbols are capped by its parser."""
    recent = files.where(F.col("indexed_at") >= since)
    grouped = symbols.groupBy("repo_id", "relative_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "kind", "id"))).alias("symbols"))
    return recent.join(grouped, ["repo_id", "relative_path"], "left")


def apply_pull(local: DataFrame, pulled: DataFrame, full: bool, key: list[str]) -> DataFrame:
    """The local rows after a pull: pulled ones replace those of their key; a full pull also drops what it doesn't have."""
    if full:
        return pulled.select(*local.columns)
    return local.join(pulled.select(*key), key, "left_anti").unionByName(pulled.select(*local.columns))


def resolved_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (repo_id, caller_id, callee_name) with the callee, if exactly one symbol of that name is in the repository or in those it imports."""
    allowed = symbols.select("repo_id").distinct().select("repo_id", F.col("repo_id").alias("target")).union(imports.where("resolved_repo IS NOT NULL").select("repo_id", F.col("resolved_repo").alias("target"))).distinct()
    candidates = allowed.join(symbols.select(F.col("repo_id").alias("target"), F.col("name").alias("callee_name"), "id"), "target")
    one = candidates.groupBy("repo_id", "callee_name").agg(F.count("*").alias("n"), F.min("id").alias("callee_id")).where("n = 1").drop("n")
    return calls.join(one, ["repo_id", "callee_name"], "left")


#: Names that frameworks call, and paths of tests.
ENTRY_POINTS = """
main init setup teardown default _start run start stop execute handler handle
beforeAll beforeEach afterAll afterEach before after
constructor componentDidMount componentWillUnmount render
""".split()
TEST_PATH = r"(?i)(^|[\\/])(tests?|__tests__|spec|specs)[\\/]|\.(test|spec)\.[^./\\]+$"


def dead_symbols(symbols: DataFrame, calls: DataFrame, repo=None, kind: str | None = None) -> DataFrame:
    """Symbols that no resolved call reaches, save containers, entry points and those in files of tests; of one repository or kind if asked for."""
    rows = symbols if repo is None else symbols.where(F.col("repo_id") == repo)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    kept = ~F.col("kind").isin(CONTAINERS) & ~F.col("name").isin(ENTRY_POINTS) & ~F.coalesce(F.col("relative_path"), F.lit("")).rlike(TEST_PATH)
    called = calls.where("callee_id IS NOT NULL").select(F.col("callee_id").alias("id")).distinct()
    return rows.where(kept).join(called, "id", "left_anti")


def enclosing(positions: DataFrame, symbols: DataFrame, lines: int = 256) -> DataFrame:
    """positions (path, line) with the innermost symbol around each; symbols are spread over stretches of lines, so the join is by equality."""
    spread = symbols.withColumn("stretch", F.explode(F.expr(f"sequence(cast(start_line div {lines} AS int), cast(end_line div {lines} AS int))")))
    at = positions.withColumn("stretch", F.expr(f"cast(line div {lines} AS int)"))
    hit = at.alias("p").join(spread.alias("s"), (F.col("p.path") == F.col("s.path")) & (F.col("p.stretch") == F.col("s.stretch")) & F.col("p.line").between(F.col("s.start_line"), F.col("s.end_line")), "left")
    size = F.col("s.end_line") - F.col("s.start_line")
    return hit.groupBy("p.path", "p.line").agg(F.min_by("s.name", F.struct(size, "s.name")).alias("symbol"))


def task_upsert(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """(title, action): requests for a title that an open task has update it, closed ones are skipped, others create."""
    known = tasks.groupBy(F.lower(T.squeezed(F.col("title"))).alias("key")).agg(F.max((F.col("status") == "open").cast("int")).alias("open"))
    action = F.when(F.col("open").isNull(), "create").when(F.col("open") == 1, "update").otherwise("skip")
    return requests.withColumn("key", F.lower(T.squeezed(F.col("title")))).join(known, "key", "left").select("title", action.alias("action"))


def new_preferences(found: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases (kind, phrase) that no known one of their kind contains, is contained in, or is within 30 per cent of edits; preferences of a kind are few."""
    far = F.levenshtein(F.lower("f.phrase"), F.lower("k.phrase")) / F.greatest(F.length("f.phrase"), F.length("k.phrase")) >= 0.3
    same = (F.col("f.kind") == F.col("k.kind")) & (F.lower("f.phrase").contains(F.lower("k.phrase")) | F.lower("k.phrase").contains(F.lower("f.phrase")) | ~far)
    return found.dropDuplicates(["kind", "phrase"]).alias("f").join(known.alias("k"), same, "left_anti")


def diary(lines: DataFrame, text: str = "line") -> DataFrame:
    """Diary lines with their agent and whether they are silent, from the markers `_via X_` and `_(silent)_`."""
    agent = F.regexp_extract(text, r"_via ([^_]+)_", 1)
    return lines.withColumn("agent", F.when(agent != "", agent)).withColumn("silent", F.col(text).contains("_(silent)_"))


def roster(entries: DataFrame) -> DataFrame:
    """(agent, entries, last_active)."""
    return entries.where("agent IS NOT NULL").groupBy("agent").agg(F.count("*").alias("entries"), F.max("at").alias("last_active"))


def merged_cluster(notes: DataFrame, cluster: str) -> DataFrame:
    """One record for each cluster: newest title, the tags that two members share, member paths; clusters are bounded by their builder."""
    tags = notes.select(cluster, "path", F.explode(F.array_distinct("tags")).alias("tag")).groupBy(cluster, "tag").agg(F.count("*").alias("n")).where("n >= 2")
    common = tags.groupBy(cluster).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    base = notes.groupBy(cluster).agg(F.max_by("title", F.struct("date", "path")).alias("title"), F.sort_array(F.collect_list("path")).alias("sources"), F.count("*").alias("members"))
    return base.join(common, cluster, "left")


def tool_search(tools: DataFrame, words: list[str], limit: int = 5) -> DataFrame:
    """Tools (name, description, cosine) by the better of cosine and 0.6 times the share of words found."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    share = sum((text.contains(w.lower()).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    score = F.greatest(F.coalesce("cosine", F.lit(0.0)), 0.6 * share)
    return tools.withColumn("score", score).orderBy(F.desc("score"), "name").limit(limit)


def trace_search(traces: DataFrame, goal: str, least: float = 0.3, as_of: str | None = None) -> DataFrame:
    """Reasoning traces whose goal's words overlap with the given ones, expired ones left out, with their outcome section."""
    words = F.array(*map(F.lit, sorted({w for w in goal.lower().split() if len(w) >= 3})))
    rows = traces.withColumn("overlap", T.jaccard(F.array_distinct(T.tokens(F.col("goal"))), words)).where(F.col("overlap") >= least)
    if as_of:
        rows = rows.where(F.col("expires").isNull() | (F.col("expires") > as_of))
    return rows.withColumn("outcome", F.trim(F.regexp_extract("content", r"(?s)## Outcome\n(.*?)(?:\n## |$)", 1))).orderBy(F.desc("overlap"), "goal")


def gold_set(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(query, expected): each titled note's title should find the note and what it links to; self-links don't count."""
    own = notes.where("title IS NOT NULL AND title <> ''").select("path", "title")
    near = links.where("src <> dst").groupBy(F.col("src").alias("path")).agg(F.collect_set("dst").alias("near"))
    return own.join(near, "path", "left").select(F.col("title").alias("query"), F.array_sort(F.array_distinct(F.concat(F.array("path"), F.coalesce("near", F.array().cast("array<string>"))))).alias("expected"))


def point_in_time(results: DataFrame) -> DataFrame:
    """Share of hits, and over queries that name what must be absent, of exact hits and of stale leaks; from (top text, expect, absent)."""
    hit = F.forall("expect", lambda s: F.col("top").contains(s))
    leak = F.exists("absent", lambda s: F.col("top").contains(s))
    temporal = F.size("absent") > 0
    return results.agg(
        F.count("*").alias("queries"),
        F.avg(hit.cast("double")).alias("recall"),
        F.avg(F.when(temporal, (hit & ~leak).cast("double"))).alias("point_in_time"),
        F.avg(F.when(temporal, leak.cast("double"))).alias("stale_leak"),
    )


def recent_first(notes: DataFrame, at: str, limit: int = 20) -> DataFrame:
    return notes.orderBy(F.desc_nulls_last(at), "path").limit(limit)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of the smallest seeded hash: the same ones whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def health_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"))


def strongest_edges(edges: DataFrame, cap: int) -> DataFrame:
    """Edges (src, dst, w) that are among the `cap` strongest of both ends."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    kept = edges.withColumn("place", place).where(F.col("place") <= cap).drop("place")
    return kept.join(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
