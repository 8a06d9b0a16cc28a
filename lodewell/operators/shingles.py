"""Hashed word pairs of texts, and SimHash fingerprints of them, by Arrow batches: what Spark's lambdas would do word by word.

Words are runs of letters and digits; they are found, hashed and paired by numpy over stretches of
texts, without a string for each word.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.functions import text as T

_KINDS = [(re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), " date "), (re.compile(r"[0-9]{1,2}:[0-9]{2}"), " time "), (re.compile(r"[0-9]+"), " num ")]
_DIGIT = re.compile("[0-9]")
#: Bytes of an Arrow batch between Spark and Python, and characters of texts that are taken together; a longer text is taken alone.
BATCH_BYTES, STRETCH = 4 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_CACHE: dict = {}


def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a number."""
    if "letters" not in _CACHE:
        _CACHE["letters"] = np.array([not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)], dtype=bool)
    return _CACHE["letters"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_CACHE.get("powers", [()])[0]) < n:
        runs = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            run = np.full(max(n, STRETCH + 1), base, np.uint64)
            run[0] = 1
            runs.append(np.cumprod(run, dtype=np.uint64))
        _CACHE["powers"] = runs
    return _CACHE["powers"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, the length and the text's number of each word of some texts, in order; equal words have equal hashes."""
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = letters()[codes]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *[len(x) + 1 for x in lowered]])
    return hashes, ends - starts, np.searchsorted(begins, starts, side="right") - 1


def structural(text: str) -> str:
    """The lowered text with dates, times and numbers replaced by their kinds, as functions.text.structural does."""
    out = text.lower()
    if _DIGIT.search(out):
        for pattern, kind in _KINDS:
            out = pattern.sub(kind, out)
    return out


def pair_sets(texts: list[str], by_structure: bool) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its neighbouring words' pairs; by structure, without short words and fillers."""
    out: list = []
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= STRETCH):
            size += len(texts[end])
            end += 1
        hashes, length, of = word_hashes([structural(t) if by_structure else t.lower() for t in texts[at:end]])
        if by_structure:
            kept = (length >= 2) & ~np.isin(hashes, _fillers())
            hashes, of = hashes[kept], of[kept]
        pairs = mixed((hashes[:-1] * np.uint64(_BASE)) ^ (hashes[1:] + np.uint64(0xD1B54A32D192ED03)))
        same = of[:-1] == of[1:]
        pairs, of = pairs[same], of[:-1][same]
        bounds = np.searchsorted(of, np.arange(end - at + 1))
        out += [np.unique(pairs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        at = end
    return out


def _fillers() -> np.ndarray:
    if "fillers" not in _CACHE:
        _CACHE["fillers"] = word_hashes(T.FILLERS)[0]
    return _CACHE["fillers"]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(key, F.col(text).cast("string").alias("text")).where("text IS NOT NULL")


def structural_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, items): hashed pairs of a text's structural words; texts of fewer than two words are left out."""

    def run(batches):
        for batch in batches:
            sets = pair_sets(batch.column(1).to_pylist(), True)
            some = [i for i, s in enumerate(sets) if len(s)]
            offsets = np.cumsum([0, *[len(sets[i]) for i in some]])
            flat = np.concatenate([sets[i] for i in some]).view(np.int64) if some else np.zeros(0, np.int64)
            items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), items], names=[key, "items"])

    return _texts(docs, key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, items array<long>")


def majority(hashes: np.ndarray) -> int:
    """The bits that most hashes have, as a signed 64-bit number; 0 for fewer than three."""
    if len(hashes) < 3:
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of the distinct pairs of a text's words; 0 for fewer than three pairs."""

    def run(batches):
        for batch in batches:
            prints = [majority(s) for s in pair_sets(batch.column(1).to_pylist(), False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[key, "simhash"])

    return _texts(docs, key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, simhash long")
