"""Language identification: nearest of several clustered centroids per language, by cosine.

A text's vector counts its byte 1-, 2- and 3-grams, lower-cased, with everything but letters as one
kind of gap, hashed to DIM bins; square roots of counts are weighted by the inverse document
frequency over all training texts and normalised. Each language's centroids are spherical k-means
clusters of a bounded sample. The best cosine decides; a text farther from its centroid than
nearly all training members is marked `rejected`, and keeps its nearest language.

Null texts and texts without a letter are `und` with score 0. With nothing to learn from, all are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import byte_view, chunks, keyed_texts, remainder, table, written

DIM, CLUSTERS, ROUNDS = 4096, 4, 12
#: Training texts that centroids are fitted on, over all languages together, at least one for each; frequencies use every training text.
SAMPLE = 4000
#: Share of training members that lie beyond a centroid's radius.
BEYOND = 0.005

#: Bytes of gaps become 0, ASCII letters and all bytes from 0x80 on stay.
_LETTERS = np.array([c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], dtype=np.uint32)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed 1- to 3-grams, a row for each text; grams of gaps alone don't count."""
    data, offsets = byte_view(texts)
    n = len(offsets) - 1
    a = _LETTERS[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
    last = np.zeros(len(a), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    counts = np.bincount((row + ((a * np.uint32(2654435761)) >> np.uint32(20)))[a > 0], minlength=n * DIM)
    if len(a) > 1:
        two = a[:-1] * np.uint32(257) + a[1:] + np.uint32(1 << 17)
        ok = ~last[:-1] & (two != np.uint32(1 << 17))
        counts += np.bincount((row[:-1] + ((two * np.uint32(2654435761)) >> np.uint32(20)))[ok], minlength=n * DIM)
    if len(a) > 2:
        three = (a[:-2] * np.uint32(66049) + a[1:-1] * np.uint32(257) + a[2:]) + np.uint32(1 << 26)
        ok = ~last[:-2] & ~last[1:-1] & (a[1:-1] > 0) & ((a[:-2] > 0) | (a[2:] > 0))
        counts += np.bincount((row[:-2] + ((three * np.uint32(2654435761)) >> np.uint32(20)))[ok], minlength=n * DIM)
    return counts.reshape(n, DIM)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(gram_counts(texts).astype(np.float32)) * idf)


def has_letter(texts: pa.Array) -> np.ndarray:
    """A letter is whatever Unicode says; only texts without an ASCII letter are looked at one by one."""
    data, offsets = byte_view(texts)
    ascii_letter = np.concatenate([[0], np.cumsum((data | 32 >= 97) & (data | 32 <= 122))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return found


def clustered(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds, without chance; also each centroid's radius, as a cosine."""
    centers = unit(x.mean(axis=0, keepdims=True))
    while len(centers) < min(k, len(x)):
        centers = np.vstack([centers, x[np.argmin((x @ centers.T).max(axis=1))]])
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        centers = unit(np.vstack([x[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))]))
    cosine = x @ centers.T
    near = np.argmax(cosine, axis=1)
    radius = np.array([np.quantile(cosine[near == c, c], BEYOND) if (near == c).any() else 1.0 for c in range(len(centers))])
    return centers.astype(np.float32), radius.astype(np.float32)


STATS = "lang string, at long, bin int, df long, vector binary"


def statistics(train: DataFrame, sample: float, seed: int = 17) -> DataFrame:
    """Document frequencies of all training texts, by task, and the counts of the sampled ones: rows of `doc_id, text, lang`.

    A text is sampled by the hash of id and text, so that copies and rows of one id count once; the
    row of each language's least hash always is.
    """

    def run(batches):
        df, n, had = np.zeros(DIM, np.int64), 0, set()
        for batch in batches:
            for part in chunks(batch):
                counts = gram_counts(part.column(1))
                df += (counts > 0).sum(axis=0)
                n += len(counts)
                take = [i for i, at in zip(np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False)), part.column(4).filter(part.column(3)).to_pylist()) if not (at in had or had.add(at))]
                if len(take):
                    rows = [np.sqrt(counts[i]).astype(np.float16).tobytes() for i in take]
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(take)), part.column(4).take(pa.array(take)), pa.nulls(len(take), pa.int32()), pa.nulls(len(take), pa.int64()), pa.array(rows, pa.binary())], names=["lang", "at", "bin", "df", "vector"])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some) + 1, pa.string()), pa.nulls(len(some) + 1, pa.int64()), pa.array([-1, *some], pa.int32()), pa.array([n, *df[some]], pa.int64()), pa.nulls(len(some) + 1, pa.binary())], names=["lang", "at", "bin", "df", "vector"])

    at = F.xxhash64("doc_id", "text", F.lit(seed))
    by_lang = train.groupBy("lang").agg(F.count("*").alias("n"), F.min(at).alias("least")).collect()
    bound = {r["lang"]: max(r["least"], min((1 << 63) - 1, int(sample / r["n"] * 2.0**64) - (1 << 63))) for r in by_lang}
    bounds = F.create_map(*[x for lang, b in bound.items() for x in (F.lit(lang), F.lit(b).cast("long"))]) if bound else F.create_map(F.lit(""), F.lit(0).cast("long"))
    return train.select("doc_id", "text", "lang", (at <= bounds[F.col("lang")]).alias("taken"), at.alias("at")).mapInArrow(run, STATS)


def fit(train: DataFrame) -> dict:
    """idf, centroids, their languages and radii, from rows (doc_id, text, lang) without nulls."""
    langs = [r["lang"] for r in train.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return {"langs": []}
    each = max(1, SAMPLE // len(langs))
    stats = written(statistics(train, each), "language-statistics")
    counted = {r["bin"]: r["df"] for r in stats.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("df").alias("df")).collect()}
    df = np.array([counted.get(i, 0) for i in range(DIM)])
    idf = (np.log((1 + counted.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)
    rows = stats.where("vector IS NOT NULL").groupBy("lang", "at").agg(F.first("vector").alias("vector")).orderBy("at").toPandas()
    model = {"langs": [], "of": [], "centers": [], "radius": [], "idf": idf}
    for lang in langs:
        own = rows.vector[rows.lang == lang][:each]
        centers, radius = clustered(unit(np.vstack([np.frombuffer(v, np.float16) for v in own]).astype(np.float32) * idf))
        model["of"] += [len(model["langs"])] * len(centers)
        model["langs"].append(lang)
        model["centers"].append(centers)
        model["radius"].append(radius)
    return model | {"centers": np.vstack(model["centers"]), "radius": np.concatenate(model["radius"]), "of": np.array(model["of"])}


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The nearest centroid's language, its cosine, and whether the text lies beyond that centroid's radius; no shuffle."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                texts = part.column(1)
                names, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                some = np.flatnonzero(has_letter(texts)) if model["langs"] else []
                if len(some):
                    cosine = vectors(texts, model["idf"])[some] @ model["centers"].T
                    near = np.argmax(cosine, axis=1)
                    score[some] = np.clip(cosine[np.arange(len(some)), near], 0, 1)
                    far[some] = score[some] < model["radius"][near]
                    for i, c in zip(some, near):
                        names[i] = model["langs"][model["of"][c]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, PREDICTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
