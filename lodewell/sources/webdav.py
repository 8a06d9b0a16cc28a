"""Files on a WebDAV server as a Spark data source: folders are listed by tasks, what has another tag is read, contents are fetched by tasks.

`register(spark)` makes the format `webdav` known. A listing has a partition for each folder below
its root and one for the root's own files; deeper folders are listed by the task that has them. Only
names are on the driver, of the root. Contents are not part of the listing: `changed` keeps the rows
whose tag differs from what is stored, and `fetched` gets those, row by row of each task.
"""

from __future__ import annotations

import base64
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, etag string, modified string, size long"
#: The protocol's request for what a listing holds.
ASKED = b'<?xml version="1.0"?><d:propfind xmlns:d="DAV:"><d:prop><d:resourcetype/><d:getetag/><d:getlastmodified/><d:getcontentlength/></d:prop></d:propfind>'


def _request(url: str, user: str | None, password: str | None, method: str, data: bytes | None = None, **headers) -> bytes:
    if user:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode()
    with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=60) as answer:
        return answer.read()


def _listed(root: str, folder: str, user: str | None, password: str | None) -> tuple[list[str], list[tuple]]:
    """(folders, files) in a folder, by paths relative to the root; files as (path, etag, modified, size)."""
    base = urllib.parse.urlsplit(root).path.rstrip("/") + "/"
    answer = _request(root.rstrip("/") + "/" + urllib.parse.quote(folder), user, password, "PROPFIND", ASKED, Depth="1", **{"Content-Type": "application/xml"})
    folders, files = [], []
    for entry in ET.fromstring(answer).iter("{DAV:}response"):
        path = urllib.parse.unquote(urllib.parse.urlsplit(entry.findtext("{DAV:}href") or "").path)
        path = path.removeprefix(urllib.parse.unquote(base))
        if path.strip("/") == folder.strip("/"):
            continue
        if entry.find(".//{DAV:}collection") is not None:
            folders.append(path.rstrip("/") + "/")
        else:
            size = entry.findtext(".//{DAV:}getcontentlength")
            files.append((path, (entry.findtext(".//{DAV:}getetag") or "").strip('"') or None, entry.findtext(".//{DAV:}getlastmodified"), int(size) if size else None))
    return sorted(folders), sorted(files)


class _Folder(InputPartition):
    """A folder that a task lists with all below it, or the root's own files."""

    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.user, self.password = options["path"], options.get("user"), options.get("password")

    def partitions(self) -> list[_Folder]:
        folders, _ = _listed(self.root, "", self.user, self.password)
        return [_Folder("", False), *[_Folder(f, True) for f in folders]]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        left = [partition.folder]
        while left:
            folders, files = _listed(self.root, left.pop(), self.user, self.password)
            yield from files
            if partition.deep:
                left += folders


class WebDav(DataSource):
    """The format `webdav`: path, etag, modified and size of all files below the address in `path`; options user and password."""

    @classmethod
    def name(cls) -> str:
        return "webdav"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebDav)


def listing(spark: SparkSession, address: str, user: str | None = None, password: str | None = None) -> DataFrame:
    """(path, etag, modified, size) of all files below an address."""
    reader = spark.read.format("webdav")
    for name, value in (("user", user), ("password", password)):
        reader = reader.option(name, value) if value else reader
    return reader.load(address)


def changed(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, etag, action) against what is stored (path, etag): fetch what is new, has another tag or has none, drop what is gone, keep the rest."""
    both = listed.select("path", "etag").withColumn("_there", F.lit(True)).join(stored.select("path", F.col("etag").alias("_old")), "path", "full_outer")
    same = F.coalesce(F.col("etag") == F.col("_old"), F.lit(False))
    return both.select("path", "etag", F.when(F.col("_there").isNull(), "drop").when(same, "keep").otherwise("fetch").alias("action"))


def fetched(rows: DataFrame, address: str, user: str | None = None, password: str | None = None) -> DataFrame:
    """Rows (path, etag) with their content; null for files that went away meanwhile."""
    root = address.rstrip("/")

    def content(path: str) -> bytes | None:
        try:
            return _request(f"{root}/{urllib.parse.quote(path)}", user, password, "GET")
        except urllib.error.HTTPError as missing:
            if missing.code in (404, 410):
                return None
            raise

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([content(p) for p in part.column(0).to_pylist()], pa.binary())], names=["path", "etag", "content"])

    return rows.select("path", "etag").mapInArrow(run, "path string, etag string, content binary")
