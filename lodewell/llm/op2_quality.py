"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in a cycle, one feature at a time, on the features' quantile bins; their
sums are lookup tables. Then the pairs of features that explain most of what is left get tables of
their own. A text's score adds up the entries of its bins, and is a logistic of the sum.

Null and empty texts have the features of an empty text and get a score like any other. Without
any label to learn from, every score is 0.5; with labels of one class alone, about 0 or 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import bounded_batches, byte_view, chunks, keyed_texts, lookup, plain_names, remainder, table

#: Labelled rows that a model is fitted on, those of the smallest hash of the id: 24 numbers each on the driver.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 150, 0.1
THRESHOLD = 0.3

_CLASSES = np.stack(
    [
        lookup(lambda c: 65 <= c <= 90),
        lookup(lambda c: 97 <= c <= 122),
        lookup(lambda c: 48 <= c <= 57),
        lookup(lambda c: c in b"!?"),
        lookup(lambda c: c in b"#$%&*+=@^~_<>{}[]\\/"),
        lookup(lambda c: c in b"|"),
        lookup(lambda c: c in b","),
        lookup(lambda c: c in b"."),
        lookup(lambda c: c in b" \t\r\n"),
        lookup(lambda c: c >= 128),
    ],
    axis=1,
).astype(np.float64)

FEATURES = (
    "upper lower digit exclaim symbol bar comma period space wide".split()
    + "log_bytes log_words word_length upper_of_letters distinct_words top_word same_as_last distinct_pairs odd_words log_line distinct_lines ended_lines exclaim_words bar_words".split()
)


def word_features(text: str) -> tuple:
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    counted: dict = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    return (
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counted) / n,
        max(counted.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(1 for w in counted if not w[-1].isalnum()) / max(1, len(counted)),
        np.log1p(len(text) / m),
        len(set(lines)) / m,
        sum(x[-1] in ".!?" for x in lines) / m,
    )


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, from the whole text."""
    data, offsets = byte_view(texts)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * 256, np.diff(offsets))
    held = np.bincount(row + data, minlength=256 * n).reshape(n, 256) @ _CLASSES
    size = np.diff(offsets)[:, None]
    share = held / np.maximum(size, 1)
    words = np.array([word_features(x or "") for x in texts.to_pylist()]).reshape(n, 10)
    n_words = np.maximum(np.expm1(words[:, :1]), 1)
    upper = held[:, :1] / np.maximum(held[:, :1] + held[:, 1:2], 1)
    return np.hstack([share, np.log1p(size), words[:, :2], upper, words[:, 2:], np.minimum(held[:, 3:4] / n_words, 4), held[:, 5:6] / n_words])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def binned(x: np.ndarray, edges: list) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def leaf(g, h):
    return g / (h + 1.0)


def gain(g, h):
    return g * g / (h + 1.0)


def tree_of_bins(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of `leaves` leaves over ordered bins, from the bins' gradients and curvatures: its value in each bin."""
    spans = [(0, len(g))]
    sums_g, sums_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a, b):
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, a
        left_g, left_h = sums_g[cut] - sums_g[a], sums_h[cut] - sums_h[a]
        all_g, all_h = sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
        gains = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
        return float(gains.max()), int(cut[gains.argmax()])

    while len(spans) < leaves:
        found = [(*best(a, b), a, b) for a, b in spans]
        most, cut, a, b = max(found)
        if most <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = leaf(sums_g[b] - sums_g[a], sums_h[b] - sums_h[a])
    return out


def tree_of_cells(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of the rows with one cut of the columns on either side: its value in each cell, and its gain."""
    value, most = np.zeros_like(g), 0.0
    for cut in range(1, g.shape[0]):
        halves, total = [], 0.0
        for part_g, part_h in ((g[:cut], h[:cut]), (g[cut:], h[cut:])):
            column = tree_of_bins(part_g.sum(axis=0), part_h.sum(axis=0), 2)
            total += float((column * part_g.sum(axis=0)).sum())
            halves.append(np.broadcast_to(column, part_g.shape))
        if total > most:
            value, most = np.vstack(halves), total
    return value, most


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> dict:
    """Tables for each feature and for the strongest pairs, from rows and labels 0 or 1."""
    edges = [quantile_edges(x[:, j], BINS) for j in range(x.shape[1])]
    coarse = [quantile_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    b, c = binned(x, edges), binned(x, coarse)
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    tables, z = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), base)
    for _ in range(rounds):
        for j, t in enumerate(tables):
            p = sigmoid(z)
            step = rate * tree_of_bins(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)))
            t += step
            z += step[b[:, j]]
    p = sigmoid(z)

    def cells(i, j):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = c[:, i] * shape[1] + c[:, j]
        return at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((tree_of_cells(*cells(i, j)[1:])[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for most, i, j in ranked[:PAIRS] if most > 1]
    for _ in range(rounds // 3):
        for i, j, t in pairs:
            p = sigmoid(z)
            at, g, h = cells(i, j)
            step = rate * tree_of_cells(g, h)[0]
            t += step
            z += step.ravel()[at]
    return {"base": base, "edges": edges, "coarse": coarse, "tables": tables, "pairs": pairs}


def score_gam(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    b, c = binned(x, model["edges"]), binned(x, model["coarse"])
    z = np.full(len(x), model["base"])
    for j, t in enumerate(model["tables"]):
        z += t[b[:, j]]
    for i, j, t in model["pairs"]:
        z += t[c[:, i], c[:, j]]
    return sigmoid(z)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of the `sample` labelled ids of the smallest hash; 16 bytes for each id are broadcast.

    An id with several labels has their largest; null labels and ids are none.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    chosen = rows.where(usable).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return keyed_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable=None, sample: int = SAMPLE) -> dict | None:
    """A model from at most `sample` labelled rows, or None without any; repeated documents count once."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in features(part.column(1))], pa.binary())], names=["doc_id", "y", "x"])

    usable = F.lit(True) if usable is None else usable
    got = labelled_sample(docs, labels, label, usable, sample).mapInArrow(run, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas().sort_values("doc_id")
    if not len(got):
        return None
    return fit_gam(np.vstack([np.frombuffer(r) for r in got.x]), (got.y.to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every text, without any shuffle; the model's tables are a few kilobytes."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_gam(model, features(part.column(1))), pa.float64())], names=["doc_id", "score"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least `threshold`, with all their columns; one scan, no join."""
    docs, names = plain_names(docs)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                text = part.column(part.schema.get_field_index("text"))
                yield part.filter(pa.array(score_gam(model, features(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
