"""Document fingerprints: the Lempel-Ziv phrase set of a text, kept as a minimum-hash signature.

A text is parsed as LZ78 does: each phrase is the shortest one not in the dictionary yet. The
phrases are hashed; the SIZE smallest hashes are the signature. The share of common values among
the SIZE smallest of two signatures' union estimates the Jaccard likeness of the phrase sets.

Null texts are empty texts. An empty text has an empty signature: its likeness is 1 to another
empty text and 0 to any other. Repeated rows each get a row, equal texts equal signatures. Rows of
one id, and rows without any, which come first, are ordered by a hash of their text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import discard, keyed_texts, span_hashes, table, written

#: Hashes of a signature; the standard error of a likeness is below 0.5 / sqrt(SIZE).
SIZE = 128
#: Rows that a bucket of consecutive ids holds on average, the most buckets there are, and sampled keys for each.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 512, 20_000, 8
#: Bytes of text that a task of the shuffle reads on average at most.
TASK_BYTES = 64 << 20


def parse(text: str, phrases: set, ends: list, at: int = 0, stop: int | None = None) -> int:
    """Adds the phrases that end by `stop` to `phrases` and their ends to `ends`; returns where the next one starts.

    The dictionary holds every prefix of its phrases, so the length of the longest known
    phrase can be sought from the last one's length up or down.
    """
    stop = len(text) if stop is None else stop
    length = 2
    known, add, keep = phrases.__contains__, phrases.add, ends.append
    while at < stop:
        end = at + length
        if end <= stop and known(text[at:end]):
            end += 1
            while end <= stop and known(text[at:end]):
                end += 1
        else:
            end = min(end, stop)
            while end - 1 > at and not known(text[at : end - 1]):
                end -= 1
            if end == stop and known(text[at:end]):
                end += 1
        if end > stop:
            return at
        add(text[at:end])
        keep(end)
        length = end - at
        at = end
    return at


def phrase_hashes(text: str, ends: list, tail: int) -> np.ndarray:
    """Hashes of the phrases that end at `ends`; what is left from `tail` on is one more phrase."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.array([*ends, *([len(text)] if tail < len(text) else [])], dtype=np.int64)
    starts = np.concatenate([np.zeros(min(1, len(stops)), np.int64), stops[:-1]])
    return np.unique(span_hashes(codes, starts, stops) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return hashes[:size]


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Jaccard estimate from two signatures; exact while both sets are within `size`."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def fingerprint(text: str | None) -> str:
    """The signature of one text, as base64 of 32-bit little-endian values in ascending order."""
    ends: list = []
    tail = parse(text or "", set(), ends)
    return encode(signature(phrase_hashes(text or "", ends, tail)))


def fingerprint_pair(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Signatures of a text and of its edited text, and the edited text; what both share is parsed once."""
    kept = len(text) - len(text) // 4
    edited = text[:kept] + following[: len(text) // 4]
    phrases: set = set()
    ends: list = []
    at = parse(text, phrases, ends, 0, kept)
    shared, other = len(ends), set(phrases)
    tail = parse(text, phrases, ends, at)
    own = signature(phrase_hashes(text, ends, tail))
    ends = ends[:shared]
    tail = parse(edited, other, ends, at)
    return own, edited, signature(phrase_hashes(edited, ends, tail))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text, without any shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def bounds_before(at: np.ndarray, h: np.ndarray, bound_at: np.ndarray, bound_h: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (at, h) are not beyond each key (at, h)."""
    low, high = np.searchsorted(bound_at, at, side="left"), np.searchsorted(bound_at, at, side="right")
    out = low.copy()
    for k in np.unique(low[low < high]):  # ids that are a bound: the hash decides
        rows = np.flatnonzero((low == k) & (low < high))
        out[rows] = k + np.searchsorted(bound_h[k : high[rows[0]]], h[rows], side="right")
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, own, at, h, doc_id, text): texts in buckets of consecutive keys, each with the first row of the next bucket, not owned.

    The key is the id (null: before all) and the hash of the text, so one id of many rows, or none,
    fills many buckets. Buckets begin at keys of a hashed sample of the rows, about one for
    BUCKET_ROWS rows, MOST_BUCKETS at most; the driver gets SAMPLED keys for each, of 16 bytes. A
    bucket is read as a sorted stream, so its size bounds no memory. The text is shuffled once,
    into as many tasks as its size asks for.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("at"), F.xxhash64("text").alias("h"), "doc_id", "text")
    narrow = written(keyed.select("at", "h", F.octet_length("text").alias("size")), "fingerprint-keys")
    n, size, least = narrow.agg(F.count("*"), F.sum("size"), F.min(F.struct("at", "h"))).first()
    parts = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    one_of = max(1, n // (parts * SAMPLED))
    sampled = narrow.where(F.pmod(F.xxhash64("at", "h"), F.lit(one_of)) == 0).select("at", "h").distinct().collect() if parts > 1 else []
    sampled = sorted((r["at"], r["h"]) for r in sampled)
    bounds = sorted({(least["at"], least["h"]), *sampled[:: max(1, len(sampled) // parts)]}) if n else [(0, 0)]
    bound_at, bound_h = np.array([x[0] for x in bounds], np.int64), np.array([x[1] for x in bounds], np.int64)
    discard(narrow)

    def deal(batches):
        for batch in batches:
            at, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            bucket = bounds_before(at, h, bound_at, bound_h) - 1
            first = np.flatnonzero((bound_at[bucket] == at) & (bound_h[bucket] == h))
            rows = pa.array(np.concatenate([np.arange(len(at)), first]))
            dealt = [pa.array(np.concatenate([bucket, (bucket[first] - 1) % len(bound_at)]), pa.int64()), pa.array(np.arange(len(rows)) < len(at), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*dealt, *(c.take(rows) for c in batch.columns)], names=["bucket", "own", "at", "h", "doc_id", "text"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    return keyed.mapInArrow(deal, "bucket long, own boolean, at long, h long, doc_id long, text string").repartition(tasks, "bucket")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(rows):
    """Rows of with_next, sorted -> (doc_id, text, own signature, edited text, its signature, likeness to the next)."""
    bucket = last = waiting = None
    for at, own, doc_id, text in rows:
        if at != bucket or last is None:
            if own:
                bucket, last, waiting = at, (doc_id, text), None
            continue
        here, edited, there = fingerprint_pair(last[1], text)
        if waiting:
            yield *waiting, likeness(waiting[2], here)
        waiting = (*last, here, edited, there)
        last = (doc_id, text)
        if not own:
            yield *waiting, likeness(here, decode(fingerprint(text)))
            waiting = last = None


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses; see the contract of op1."""

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    yield from zip(*(part.column(k).to_pylist() for k in (0, 1, 4)), (x or "" for x in part.column(5).to_pylist()))

        out: list = []
        for doc_id, text, here, edited, there, near_next in compare_neighbours(rows()):
            out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(here), encode(there), likeness(here, there), near_next))
            if len(out) == 1024:
                yield to_batch(out)
                out = []
        if out:
            yield to_batch(out)

    def to_batch(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    dealt = with_next(keyed_texts(docs, id_col, text_col))
    return dealt.sortWithinPartitions("bucket", F.desc("own"), "at", "h", F.asc_nulls_first("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))
