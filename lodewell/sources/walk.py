"""Walks of repositories: layered ignore files as a join over ancestors, and indexing of what changed alone.

A path is looked at with each of its folders: for every one of these, the rules of the ignore files in
the folders above it are joined on the folder, and the last rule of the nearest file that matches
decides, negated or not. A path is ignored if it or one of its folders is: what lies in an ignored
folder can't be had back. Rules are few for a folder, and paths are short, so the join is narrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.sources.code import MOST_BYTES, language

#: Names of folders that are never walked, of any depth.
SKIPPED = ["node_modules", "dist", ".git", ".next", "build", "out", "target", "__pycache__", "venv", ".venv", "vendor", ".history"]
DENIED = [".obsidian", ".sync", ".trash"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of all files below a folder of any file system that Spark reads, by path relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, root: str, kept: DataFrame) -> DataFrame:
    """(path, content, content_hash) of those files below the folder that `kept` (path) names, text in UTF-8, binary ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
    rows = files.select(_relative(F.col("path"), root).alias("path"), "content").join(kept.select("path"), "path", "left_semi")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("content"), F.sha1("content").alias("content_hash")).where(F.col("content").isNotNull() & ~F.col("content").contains("\x00"))


def ignore_files(spark: SparkSession, root: str, paths: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(path, content) of the ignore files in the folders of the paths and above. Spark lists no hidden files, so each folder is asked for its own by the file system's interface: as many look-ups on the driver as there are folders."""
    parts = F.split("path", "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    jvm, found = spark._jvm, []
    for folder in [r["folder"] for r in folders.collect()] or [""]:
        inside = f"{folder}/{name}".lstrip("/")
        where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{inside}")
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(where):
            stream = system.open(where)
            found.append((inside, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(found, "path string, content string")


def _relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/+(?=/)|^file:(?=/)", "")
    start = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.when(F.contains(bare, F.lit(start)), F.substring_index(bare, start, -1)).otherwise(bare)


def rule_pattern(rule: Column) -> Column:
    """A regular expression for the glob of a rule (no leading or trailing slash): ** any folders, * and ? within a name, sets in brackets."""
    quoted = F.regexp_replace(rule, r"([.+(){}^$|\\])", r"\\$1")
    quoted = F.regexp_replace(F.regexp_replace(quoted, r"^\*\*/", "\x01"), r"/\*\*/", "\x02")
    quoted = F.regexp_replace(F.regexp_replace(quoted, r"/\*\*$", "/\x03"), r"\*+", "[^/]*")
    quoted = F.regexp_replace(F.regexp_replace(quoted, r"\?", "[^/]"), r"\[!", "[^")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, "\x01", "(?:.*/)?"), "\x02", "/(?:.*/)?"), "\x03", ".+")


def ignore_rules(files: DataFrame) -> DataFrame:
    """(folder, number, negated, folders_only, pattern) of ignore files (path, content); the pattern is of paths relative to the folder.

    A rule with a slash at its begin or within is anchored to its folder, any other one matches at any
    depth. Lines that are blank or begin with # are none; \\! and \\# stand for themselves.
    """
    rows = files.select(F.regexp_extract("path", r"^(.*?)/?[^/]+$", 1).alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("number", "line"))
    line = F.regexp_replace("line", r"(?<!\\) +$", "")
    rows = rows.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("negated", F.col("line").startswith("!")).withColumn("line", F.regexp_replace(F.regexp_replace("line", "^!", ""), r"^\\([!#])", "$1"))
    rows = rows.withColumn("folders_only", F.col("line").endswith("/")).withColumn("line", F.regexp_replace("line", "/$", ""))
    anchored = F.col("line").contains("/")
    bare = rule_pattern(F.regexp_replace("line", "^/", ""))
    return rows.where("line <> ''").select("folder", "number", "negated", "folders_only", F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), bare, F.lit("$")).alias("pattern"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of files that some rule ignores, in themselves or by a folder of theirs."""
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    each = paths.select("path", parts.alias("parts")).select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    each = each.select("path", "parts", "n", upto(F.col("n")).alias("at"), (F.col("n") < F.size("parts")).alias("is_folder"))
    above = each.select("path", "n", "at", "is_folder", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("depth"), "parts")
    above = above.withColumn("folder", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    inner = F.when(F.col("folder") == "", F.col("at")).otherwise(F.substring(F.col("at"), F.length("folder") + 2, F.length("at")))
    hit = above.join(rules, "folder").where((F.col("is_folder") | ~F.col("folders_only")) & F.regexp_like(inner, F.col("pattern")))
    last = hit.groupBy("path", "n").agg(F.max_by("negated", F.struct("depth", "number")).alias("negated"))
    return last.where("NOT negated").select("path").distinct()


def walked(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths (path, ...) of files in a known language that lie in no skipped folder and that no rule ignores, with their language."""
    never = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED + DENIED)))
    rows = paths.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~never)
    return rows.join(ignored(rows.select("path"), rules), "path", "left_anti")


def changes(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) of files now (path, content_hash) against those of the index: parse what is new or has another hash, prune what is gone, keep the rest."""
    both = now.select("path", "content_hash").join(stored.select("path", F.col("content_hash").alias("old")), "path", "full_outer")
    action = F.when(F.col("content_hash").isNull(), "prune").when(F.col("old").isNull() | (F.col("old") != F.col("content_hash")), "parse").otherwise("keep")
    return both.select("path", action.alias("action"))


def reindexed(now: DataFrame, files: DataFrame, rows: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The index's files (path, content_hash) and rows (path, ...) after files changed: only what `changes` says to parse goes through `parse`."""
    plan = changes(now, files)
    fresh = now.join(plan.where("action = 'parse'").select("path"), "path", "left_semi")
    kept = rows.join(plan.where("action = 'keep'").select("path"), "path", "left_semi")
    return now.select("path", "content_hash"), kept.unionByName(parse(fresh).select(*rows.columns))

