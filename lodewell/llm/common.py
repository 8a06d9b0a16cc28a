"""Helpers the operators share: a shared work folder, written intermediate tables, byte-level text views."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that vectorised operators hold at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 19
CHUNK_DOCS = 512
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir; where it is unset, the warehouse, or in local mode a temporary folder."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local-cluster") and context.master.startswith("local"):
        made = "file://" + tempfile.mkdtemp(prefix="lodewell-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodewell_work"
    context.setCheckpointDir(made)
    return made


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame, tidy: bool = False) -> None:
    """Deletes a written table that no unfinished frame reads any more; `tidy` also has Spark drop shuffle files of finished steps."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tidy:
        gc.collect()
        jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in batches of BATCH_BYTES, whatever their lengths; a session setting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unkept(shared):
    """The value of a broadcast, read anew and not kept in the worker's memory."""
    value = shared.value
    if getattr(shared, "_path", None):
        vars(shared).pop("_value", None)
    return value


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until it clashes with none of `names`."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_names(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with plain names for columns whose names hold dots or backquotes, which mapInArrow can't take, and the names it had."""
    names = docs.columns
    if not any(set(n) & set(".`") for n in names):
        return docs, names
    return docs.toDF(*[fresh(names, f"_column{i}")[0] if set(n) & set(".`") else n for i, n in enumerate(names)]), names


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text; other columns, whatever their names, play no part."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo the given number; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, without copying; a null is an empty text."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text_col: str = "text", limit: int = CHUNK_BYTES, most: int = CHUNK_DOCS):
    """Slices of a batch that hold about `limit` bytes of text and `most` rows at most; every row is in exactly one."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = byte_view(batch.column(batch.schema.get_field_index(text_col)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, at + most, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    have = max(_POWERS, default=0)
    if have < n:
        size = max(n, 1 << 16)
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            both.append(np.cumprod(run, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = tuple(both)
        have = size
    up, down = _POWERS[have]
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal spans have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs where `word` is set, none across a text's end, and the number of runs in each text."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(word))]
    before[inner], after[inner - 1] = 0, 0
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lookup(chosen) -> np.ndarray:
    return np.array([chosen(c) for c in range(256)], dtype=bool)


LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
