"""A persisted index of vectors: an inverted file of k-means cells, searched cell by cell.

Centroids are fitted on SAMPLE vectors at most (the least hashes of ids); every vector is indexed, in
the cell of its nearest centroid. Cells are the partitions of a Parquet table, so a search reads the
cells that it probes; a cell of many rows lies in parts of PART_ROWS, each a file and a task of its
own, whatever cell holds a third of the rows. A search sends each query to the nearest cells, in
blocks of QUERY_ROWS for each cell and part, multiplies the block with the part, and re-ranks exactly:
scores are the cosines of the stored vectors, and with all cells probed the result is the exact one.
How many cells a search probes is measured when the index is built: as many as hold TARGET of the ten
nearest rows of sampled queries, which for vectors without clusters is most of the cells.

Vectors are taken to unit length; null ones, and those without extent, are not indexed and no queries.
Repeated ids are rows of their own, but one query (the least vector's). A query does not find rows of
its own id. Ties are ordered by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that centroids are fitted on, rounds of the fit, most cells, rows of a part of a cell, queries of a block.
SAMPLE, ROUNDS, MOST_CELLS, PART_ROWS, QUERY_ROWS = 50_000, 12, 4096, 20_000, 2_000
#: Numbers that a task holds at a time where rows meet centroids: their scores, and the copies of a row for its cells.
TILE = 1 << 20
#: Share of the nearest rows that a search is to find, and sampled queries that the cells to probe for it are measured with.
TARGET, TRIED = 0.95, 500


def _rows(vectors: DataFrame, key: str) -> DataFrame:
    """(vec_id, embedding) of unit length."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("embedding"), norm.alias("_norm")).where("_norm > 0").select("vec_id", F.transform("embedding", lambda x: x / F.col("_norm")).alias("embedding"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: begins with every so many'th row, an empty cell takes the row that is furthest from its own centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        score = sample @ centroids.T
        own, near = score.argmax(axis=1), score.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(near, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        following = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
        if np.allclose(following, centroids):
            break
        centroids = following
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, target: float, k: int = 10) -> int:
    """The nearest cells that hold `target` of the k nearest sampled rows of sampled queries."""
    tried = np.unique(np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int))
    own, ranks = (sample @ centroids.T).argmax(axis=1), []
    for i in tried:
        score = sample @ sample[i]
        score[i] = -np.inf
        order = np.empty(len(centroids), int)
        order[np.argsort(-(centroids @ sample[i]), kind="stable")] = np.arange(len(centroids))
        ranks.append(order[own[np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]]])
    ranks = np.sort(np.concatenate(ranks)) if len(sample) > 1 else np.zeros(1, int)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def nearest_cells(rows: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """(vec_id, embedding, cell) with each row's `most` nearest cells; centroids are 4096 at most, so they ride with the function."""

    cells, size = centroids.shape
    step = max(1, TILE // max(1, cells, min(most, cells) * size))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                score = _matrix(batch.column(1), size) @ centroids.T
                top = np.argpartition(-score, min(most, cells) - 1, axis=1)[:, :most]
                again = pa.array(np.repeat(np.arange(len(top)), top.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(top.ravel().astype(np.int32))], names=["vec_id", "embedding", "cell"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, cell int")


def write_index(vectors: DataFrame, path: str, key: str = "vec_id", cells: int | None = None, target: float = TARGET) -> str:
    """Writes the index of all vectors to the folder `path`, which must not be there yet, and returns it; the square root of the rows is the number of cells, unless it is given."""
    rows = _rows(vectors, key)
    n = rows.count()
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(1, n))
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    size = len(found.column(1)[0]) if n else 0
    sample = _matrix(found.column(1), size) if n else np.zeros((0, 0))
    centroids = fit(sample, min(cells, found.num_rows)) if n else sample
    spark = vectors.sparkSession
    if n:
        placed = nearest_cells(rows, centroids, 1)
        counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
        parts = counts.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.element_at("embedding", 1)), F.col("parts")).cast("int"))
        dealt.select("cell", "part", "vec_id", "embedding").repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")
    totals = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).collect() if n else []
    told = [(int(r["cell"]), centroids[r["cell"]].tolist(), r["n"], r["parts"]) for r in totals]
    spark.createDataFrame(told, "cell int, centroid array<double>, n long, parts long").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(n, needed_probes(sample, centroids, target) if n else 0, target)], "rows long, probes int, target double").coalesce(1).write.parquet(f"{path}/fit")
    return path


#: For `probes`: all cells, which makes a search exact.
ALL = -1


def _probes(spark: SparkSession, path: str, cells: int, probes: int | None) -> int:
    found = spark.read.parquet(f"{path}/fit").first()["probes"] if probes is None else probes
    return cells if found == ALL else min(cells, found)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, list, np.ndarray]:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return spark.read.schema("part int, vec_id long, embedding array<double>, cell int").parquet(f"{path}/vectors") if cells else None, cells, np.array([r["centroid"] for r in cells])


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, key: str = "vec_id") -> DataFrame:
    """(query, vec_id, score, place): each query's k nearest rows of other ids in the cells that it probes, as many as the index was built for; ALL is exact."""
    index, cells, centroids = _opened(spark, path)
    schema = "query long, vec_id long, score double"
    if not cells:
        return spark.createDataFrame([], schema + ", place int")
    number = np.array([r["cell"] for r in cells], np.int32)
    sent = nearest_cells(_rows(queries, key).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), centroids, _probes(spark, path, len(cells), probes))
    names = F.array(*[F.lit(int(c)) for c in number])  # centroids are in the order of their cells
    sent = sent.withColumn("cell", F.element_at(names, F.col("cell") + 1))
    parts = spark.createDataFrame([(r["cell"], r["parts"]) for r in cells], "cell int, parts long")
    asked = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    # a row for each cell: 4096 at most
    q = sent.join(F.broadcast(parts), "cell").join(F.broadcast(asked), "cell")
    q = q.select("cell", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "embedding")
    v = index.join(F.broadcast(asked), "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "vec_id", "embedding")
    size = centroids.shape[1]

    def best(asked_: pa.Table, held: pa.Table) -> pa.Table:
        ids, wanted = held.column("vec_id").to_numpy(), asked_.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], _matrix(held.column("embedding"), size)[order]
        out: list = []
        for at in range(0, len(wanted) if len(ids) else 0, 256):
            some = wanted[at : at + 256]
            score = np.round(_matrix(asked_.column("embedding").slice(at, 256), size) @ vectors.T, 6)
            score[some[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # by score, then by id
            near = np.take_along_axis(score, top, axis=1).ravel()
            ok = near > -np.inf
            out.append((np.repeat(some, top.shape[1])[ok], ids[top].ravel()[ok], near[ok]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query", "vec_id", "score"), columns)))

    keys = ["cell", "part", "block"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(best, schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(spark: SparkSession, path: str, query: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
    """(vec_id, score) of the k rows nearest to one vector in the cells that it probes: a filter on the partitions, so only their files are read."""
    index, cells, centroids = _opened(spark, path)
    wanted = np.asarray(query, float)
    norm = np.linalg.norm(wanted)
    if not cells or not norm:
        return spark.createDataFrame([], "vec_id long, score double")
    wanted = wanted / norm
    chosen = [cells[i]["cell"] for i in np.argsort(-(centroids @ wanted), kind="stable")[: _probes(spark, path, len(cells), probes)]]
    score = F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, wanted.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return index.where(F.col("cell").isin(chosen)).select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, neighbours that are to be found, and the share of them that was; equal scores stand for one another."""
    worst = exact.groupBy("query").agg(F.count("*").alias("wanted"), F.min("score").alias("worst"))
    good = found.join(worst, "query").where(F.col("score") >= F.col("worst")).groupBy("query").agg(F.count("*").alias("found"))
    each = worst.join(good, "query", "left").select("wanted", F.least("wanted", F.coalesce("found", F.lit(0))).alias("found"))
    return each.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("found") / F.sum("wanted")).alias("recall"))
