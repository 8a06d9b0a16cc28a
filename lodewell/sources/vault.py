"""Notes from folders of Markdown files, and other file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions import text as T

#: Media types by extension; anything else is a stream of octets.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "csv": "text/csv", "json": "application/json", "txt": "text/plain", "md": "text/markdown"}

_FENCE = r"(?s)^---\n(.*?)\n---\n?(.*)$"


def read_vault(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, content, modified, size) of the files below `root`, whole files, read by executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def front_matter(files: DataFrame) -> DataFrame:
    """Adds `meta`, a map of the front matter's `key: value` lines, and `body`; lists `[a, b]` and `- a` lines are kept as comma-joined text."""
    normal = F.regexp_replace("content", r"\r\n?", "\n")
    head = F.regexp_extract(normal, _FENCE, 1)
    flat = F.regexp_replace(head, r"\n\s*- ", ", ")  # list items join their key's line
    lines = F.filter(F.split(flat, "\n"), lambda s: s.rlike(r"^[A-Za-z_][\w-]*:"))
    value = lambda s: F.trim(F.regexp_replace(F.regexp_extract(s, r"^[^:]+:\s*,?\s*(.*)$", 1), r"^[\[\"']|[\]\"']$", ""))
    meta = F.map_from_entries(F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([^:]+):", 1).alias("key"), value(s).alias("value"))))
    return files.withColumn("meta", meta).withColumn("body", F.when(normal.rlike(_FENCE), F.regexp_extract(normal, _FENCE, 2)).otherwise(normal))


def as_notes(files: DataFrame) -> DataFrame:
    """Notes with the known keys as columns: title (else the file's name), tags, date, type, category, collection, validity."""
    rows = front_matter(files)
    meta = lambda k: rows["meta"][k]
    tags = F.filter(F.transform(F.split(F.coalesce(meta("tags"), F.lit("")), r"\s*,\s*"), lambda t: F.lower(F.trim(F.regexp_replace(t, "^#+", "")))), lambda t: t != "")
    return rows.select(
        "path",
        F.coalesce(meta("title"), F.regexp_replace(T.basename(F.col("path")), r"\.md$", "")).alias("title"),
        F.col("body").alias("content"),
        tags.alias("tags"),
        meta("date").alias("date"),
        meta("type").alias("type"),
        meta("category").alias("category"),
        F.coalesce(meta("collection"), F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)), F.lit("general")).alias("collection"),
        F.try_to_date(F.substring(meta("valid_from"), 1, 10)).alias("valid_from"),
        F.try_to_date(F.substring(meta("valid_to"), 1, 10)).alias("valid_to"),
        meta("superseded_by").alias("superseded_by"),
        T.wikilinks(F.col("body")).alias("links"),
        F.sha2("content", 256).alias("etag"),
        "modified",
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file without blank lines and comments; a malformed line fails if strict, else is left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|//|$)"))
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok")).where("ok").select("r.*")


def split_lines(notes: DataFrame, text: str = "content") -> DataFrame:
    """A row for each line of a note, numbered from 1."""
    return notes.select("*", F.posexplode(F.split(text, "\n")).alias("_at", "line")).withColumn("line_number", F.col("_at") + 1).drop("_at")


def open_tasks(notes: DataFrame, text: str = "content") -> DataFrame:
    """(path, tasks) of notes with open check boxes."""
    tasks = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*- \[ \] "))
    return notes.select("path", tasks.alias("tasks")).where(F.size("tasks") > 0)


def compare_and_swap(notes: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after the writes, conflicts): a write (path, content, if_match) holds if its etag is the note's, or the note is new and none is given."""
    both = notes.select("path", F.col("content").alias("old")).join(writes.select("path", F.col("content").alias("new"), "if_match", F.lit(True).alias("wrote")), "path", "full_outer")
    etag = F.sha2("old", 256)
    holds = F.col("wrote") & F.when(F.col("old").isNull(), F.col("if_match").isNull()).otherwise(F.coalesce(F.col("if_match") == etag, F.lit(False)))
    after = both.select("path", F.when(F.coalesce(holds, F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("content")).where("content IS NOT NULL")
    return after, both.where(F.col("wrote") & ~holds).select("path", "if_match", etag.alias("etag"))


def merged_section(old, heading: str, new):
    """The text with the section below `heading` replaced, or added at the end; column expressions."""
    pattern = rf"(?s)(^|\n)(#+ {heading}\n).*?(?=\n#+ |$)"
    there = old.rlike(pattern)
    quoted = F.regexp_replace(new, r"([\\$])", r"\\$1")
    replaced = F.call_function("regexp_replace", old, F.lit(pattern), F.concat(F.lit("$1$2"), quoted))
    return F.when(there, replaced).otherwise(F.concat(old, F.lit(f"\n\n## {heading}\n"), new))


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as a Parquet table by collection; only collections with rows are replaced."""
    notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def read_artifacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, extension, mime, size, etag, modified) of binary files in any file system that Spark reads (local, HDFS, object stores); contents are hashed by executors, not kept; Spark does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = T.basename(F.col("path"))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    mime = F.coalesce(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])[extension], F.lit("application/octet-stream"))
    return files.select("path", name.alias("name"), extension.alias("extension"), mime.alias("mime"), F.col("length").alias("size"), F.sha2("content", 256).alias("etag"), F.col("modificationTime").alias("modified"))


def repositories(listing: DataFrame) -> DataFrame:
    """(root): folders of a listing (path) that hold a repository, those within another one's working tree left out."""
    roots = listing.select(F.regexp_extract("path", r"^(.*)/\.git/HEAD$", 1).alias("root")).where("root <> ''").distinct()
    parts = F.split("root", "/")
    above = F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    nested = roots.select("root", above.alias("above")).where("above <> root").join(roots.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct()
    return roots.join(nested, "root", "left_anti")
