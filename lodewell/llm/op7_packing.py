"""Packing: best-fit decreasing over pieces of tokenised documents, in bulk.

A document of more than a window's tokens is cut into full windows and a rest. Best-fit
decreasing treats pieces of one length alike, so the placing is decided on the driver from the
histogram of lengths, which has `window` rows at most whatever the corpus: a segment tree over
remaining capacities finds the tightest open windows, runs of alike windows are filled at once,
and the result is a plan of rules "pieces of this length with ranks from - to go to windows
from - on". Every piece then finds its rule by its rank among the pieces of its length, which is
counted per task and shifted by the sums of the tasks before.

Null texts are empty documents; each document ends with `end_id`, so none is without a piece.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import keyed_texts, table, written

WINDOW, END_ID = 2048, 1
#: The special token of the vocabulary, and its pre-tokenisation pattern.
SPECIAL = {"<|endoftext|>": 50256}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict = {}


def encoder(path: str):
    """text -> ids of the byte-level BPE whose ranks lie at `path`; the same ids as the vocabulary's JSON file gives in `tokenizers`."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        made = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        _ENCODERS[path] = lambda text: made.encode(text, allowed_special="all")
    return _ENCODERS[path]


class Tightest:
    """A segment tree over capacities 0..size: which are open, and the least open one that is not below a length."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, capacity: int, some: bool) -> None:
        at = capacity + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def find(self, length: int) -> int | None:
        at = length + self.leaves
        if self.some[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, end rank, pieces in each window, first window, offset) of best-fit decreasing."""
    rules, windows = [], 0
    tree, runs = Tightest(window), defaultdict(list)

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            runs[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.find(length)
            if capacity is None:
                capacity, first = window, windows
                count = -(-left // (window // length))
                windows += count
            else:
                first, count = runs[capacity].pop()
                if not runs[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            whole = min(count, left // each)
            if whole:
                rules.append((length, rank, rank + whole * each, each, first, window - capacity))
                put(capacity - each * length, first, whole)
                rank, left, first, count = rank + whole * each, left - whole * each, first + whole, count - whole
            if count and 0 < left < each:
                rules.append((length, rank, rank + left, left, first, window - capacity))
                put(capacity - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            put(capacity, first, count)
    return rules


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; `rank` counts the pieces of the same length in the same task, `part`."""

    def run(batches):
        encode, seen, part = encoder(vocabulary), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                out = []
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in PIECES.split(", ")])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there.

    Texts are tokenised once and not shuffled. Written between: one narrow row for each piece.
    The plan holds a rule for each run of alike windows, at most a few for each length, so it is broadcast.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, window, end_id, id_col, text_col), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules = spark.createDataFrame(best_fit(histogram, window), "length long, first long, end long, each long, window0 long, offset0 long")
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("k", F.col("before") + F.col("rank")).alias("p")
    at = F.col("k") - F.col("first")
    return ranked.join(F.broadcast(rules.alias("r")), (F.col("p.length") == F.col("r.length")) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end"))).select(
        "doc_id",
        "start",
        "p.length",
        "ids_crc32",
        "doc_tokens",
        (F.col("window0") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + (at % F.col("each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def vocabulary_path() -> str:
    """Where the installed package of public vocabularies keeps the ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
