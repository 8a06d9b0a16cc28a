"""Code navigation on tables of symbols, calls, files and repositories: outlines, context, audits, changes, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of symbols that span others.
CONTAINERS = ["class", "struct", "enum", "trait", "interface", "impl", "module", "namespace", "union"]


def outline(symbols: DataFrame, repo, path) -> DataFrame:
    """The symbols of one file in the order of their first lines."""
    return symbols.where((F.col("repo_id") == repo) & (F.col("relative_path") == path)).orderBy("start_line", "id")


def call_counts(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """symbols with caller_count, callee_count and external_caller_count (calls from other files); resolved calls only."""
    resolved = calls.where("callee_id IS NOT NULL").select("caller_id", "callee_id")
    place = symbols.select("id", "relative_path")
    both = resolved.join(place.select(F.col("id").alias("callee_id"), F.col("relative_path").alias("to_path")), "callee_id", "left").join(place.select(F.col("id").alias("caller_id"), F.col("relative_path").alias("from_path")), "caller_id", "left")
    called = both.groupBy(F.col("callee_id").alias("id")).agg(F.count("*").alias("caller_count"), F.count_if(F.col("from_path") != F.col("to_path")).alias("external_caller_count"))
    calling = resolved.groupBy(F.col("caller_id").alias("id")).agg(F.count("*").alias("callee_count"))
    return symbols.join(called, "id", "left").join(calling, "id", "left").na.fill(0, ["caller_count", "callee_count", "external_caller_count"])


def file_audit(symbols: DataFrame, calls: DataFrame, heaviest: int = 5) -> DataFrame:
    """For each file: symbols, entry points (called from elsewhere), and its `heaviest` longest symbols that are no containers."""
    loc = F.col("end_line") - F.col("start_line") + 1
    counted = call_counts(symbols, calls).withColumn("loc", loc)
    file = ["repo_id", "relative_path"]
    place = F.row_number().over(Window.partitionBy(*file).orderBy(F.desc("loc"), "start_line", "id"))
    heavy = counted.where(~F.col("kind").isin(CONTAINERS)).withColumn("place", place).where(F.col("place") <= heaviest).groupBy(*file).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("heaviest"))
    totals = counted.groupBy(*file).agg(F.count("*").alias("symbols"), F.sum("loc").alias("loc"), F.count_if(F.col("external_caller_count") > 0).alias("entry_points"), F.sum("caller_count").alias("callers"))
    return totals.join(heavy, file, "left")


def file_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct (repo_id, src, dst): files whose symbols call those of another file of the same repository."""
    place = symbols.select("id", "repo_id", "relative_path")
    caller = place.select(F.col("id").alias("caller_id"), "repo_id", F.col("relative_path").alias("src"))
    callee = place.select(F.col("id").alias("callee_id"), F.col("repo_id").alias("callee_repo"), F.col("relative_path").alias("dst"))
    pairs = calls.where("callee_id IS NOT NULL").select("caller_id", "callee_id").distinct()
    return pairs.join(caller, "caller_id").join(callee, "callee_id").where("repo_id = callee_repo AND src <> dst").select("repo_id", "src", "dst").distinct()


def full_context(symbol: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, callers: int = 5, callees: int = 5) -> DataFrame:
    """One row: the symbol (id, name, kind, relative_path, repo_id), its first callers and callees by name, and its file's imports."""
    named = symbols.select("id", "name")
    into = calls.join(F.broadcast(symbol.select(F.col("id").alias("callee_id"))), "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct()
    out = calls.where("callee_id IS NOT NULL").join(F.broadcast(symbol.select(F.col("id").alias("caller_id"))), "caller_id", "left_semi").select(F.col("callee_id").alias("id")).distinct()
    first = lambda rows, n: named.join(rows, "id").orderBy("name", "id").limit(n).agg(F.array_sort(F.collect_list("name")).alias("names"))
    own = imports.join(F.broadcast(symbol.select("repo_id", "relative_path")), ["repo_id", "relative_path"], "left_semi").agg(F.array_sort(F.collect_set("module")).alias("imports"))
    # each side is one row
    return symbol.crossJoin(first(into, callers).withColumnRenamed("names", "callers")).crossJoin(first(out, callees).withColumnRenamed("names", "callees")).crossJoin(own)


def changes_since(log: DataFrame, since, kind: str = "all", prefix: str = "", limit: int = 200) -> DataFrame:
    """The newest changes of a log (id, relative_path, change_kind, captured_at, ...) from `since` on; `truncated` tells whether there were more."""
    rows = log.where(F.col("captured_at") >= since)
    if kind != "all":
        rows = rows.where(F.col("change_kind") == kind)
    if prefix:
        rows = rows.where(F.col("relative_path").startswith(prefix))
    order = [F.desc("captured_at"), F.desc("id")]
    page = rows.orderBy(*order).limit(limit + 1)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over limit + 1 rows
    return page.withColumn("truncated", n > limit).withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def code_stats(repos: DataFrame, files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """For each repository (repo_id, slug): symbols, files, last indexed, resolved and unresolved calls; repositories without any have 0."""
    s = symbols.groupBy("repo_id").agg(F.count("*").alias("symbols"))
    f = files.groupBy("repo_id").agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed_at"))
    c = calls.groupBy("repo_id").agg(F.count_if(F.col("callee_id").isNotNull()).alias("resolved"), F.count_if(F.col("callee_id").isNull()).alias("unresolved"))
    out = repos
    for part in (s, f, c):
        out = out.join(part, "repo_id", "left")
    return out.na.fill(0, ["symbols", "files", "resolved", "unresolved"])


def scan_totals(stats: DataFrame) -> DataFrame:
    """Totals over all repositories that have a file."""
    return stats.where("files > 0").agg(F.count("*").alias("repos"), F.sum("files").alias("files"), F.sum("symbols").alias("symbols"), F.sum(F.col("resolved") + F.col("unresolved")).alias("calls"))


def dominant_repo(results: DataFrame, group: str) -> DataFrame:
    """(group, repo_id): the repository that most results of a group come from; the least one of several."""
    counts = results.groupBy(group, "repo_id").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by("repo_id", F.struct(-F.col("n"), "repo_id")).alias("repo_id"))


def locality(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Where repositories lie: (repo_id, machine_id, abs_path, last_seen_at) with the time of the last indexing, newest first."""
    last = files.groupBy("repo_id").agg(F.max("indexed_at").alias("last_indexed_at"))
    return paths.join(last, "repo_id", "left").orderBy("repo_id", F.desc("last_seen_at"), "machine_id")


def repo_identity(origin: Column, first_commit: Column) -> Column:
    """16 hex digits: the hash of the origin, or the first commit's where there is no origin."""
    clean = F.trim(origin)
    return F.coalesce(F.when(clean != "", F.substring(F.sha1(clean), 1, 16)), F.substring(first_commit, 1, 16))


def registry_after(repos: DataFrame, actions: DataFrame) -> DataFrame:
    """repos (repo_id, slug, name) after the latest action of each (repo_id, action, slug, name, at): register, rename or drop.

    Registering a known repository renames it; renaming an unknown one does nothing.
    """
    last = actions.groupBy("repo_id").agg(F.max_by(F.struct("action", F.col("slug").alias("new_slug"), F.col("name").alias("new_name")), "at").alias("a")).select("repo_id", "a.*")
    both = repos.withColumn("known", F.lit(True)).join(last, "repo_id", "full_outer")
    there = F.coalesce("known", F.lit(False)) | F.coalesce(F.col("action") == "register", F.lit(False))
    kept = both.where(there & F.coalesce(F.col("action") != "drop", F.lit(True)))
    return kept.select("repo_id", F.coalesce("new_slug", "slug").alias("slug"), F.coalesce("new_name", "name").alias("name"))


def projection(symbols: DataFrame, calls: DataFrame, most: int = 20) -> DataFrame:
    """(id, note, hash): a Markdown note of each symbol with its first callers and callees; equal hashes need no new write."""
    named = symbols.select("id", "name")

    def side(mine: str, other: str, label: str) -> DataFrame:
        pairs = calls.where("callee_id IS NOT NULL").select(F.col(mine).alias("id"), F.col(other).alias("other")).distinct()
        rows = pairs.join(named.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")
        place = F.row_number().over(Window.partitionBy("id").orderBy("other_name", "other"))
        listed = rows.withColumn("place", place).where(F.col("place") <= most).groupBy("id").agg(F.array_sort(F.collect_list("other_name")).alias("names"))
        return listed.select("id", F.array_join(F.transform("names", lambda n: F.concat(F.lit("- [["), n, F.lit("]]"))), "\n").alias(label))

    rows = symbols.join(side("callee_id", "caller_id", "callers"), "id", "left").join(side("caller_id", "callee_id", "callees"), "id", "left")
    none = F.lit("- none")
    note = F.concat(F.lit("# "), "name", F.lit("\n\n`"), F.coalesce("signature", F.lit("")), F.lit("`\n\n## Callers\n"), F.coalesce("callers", none), F.lit("\n\n## Callees\n"), F.coalesce("callees", none), F.lit("\n"))
    return rows.select("id", note.alias("note")).withColumn("hash", F.sha2("note", 256))
