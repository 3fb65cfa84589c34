"""K-means in Spark rounds with seeds drawn by distance, and the number of clusters chosen by silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import work_folder

#: Rounds that draw seeds, candidates expected a round for each cluster, and most rounds of means.
SEED_ROUNDS, OVERSAMPLE, ROUNDS = 4, 2, 20


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest center; ties to the first."""
    far = (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)
    index = far.argmin(1)
    return index, ((points - centers[index]) ** 2).sum(1)


def assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``rows`` (id, v) with cluster and distance (squared)."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, far = _nearest(_points(batch.column("v")), shared.value) if batch.num_rows else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.astype("i4")), pa.array(far)], names=[*batch.schema.names, "cluster", "distance"])

    return rows.mapInArrow(place, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, cluster int, distance double")


def sums_of(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(number, sum of vectors, sum of squared lengths) of each center's nearest points and the inertia; every task adds its own up, so a row a task and cluster is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    k, d = centers.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square, inertia = np.zeros(k), np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                points = _points(batch.column("v"))
                index, far = _nearest(points, shared.value)
                n += np.bincount(index, minlength=k)
                np.add.at(total, index, points)
                square += np.bincount(index, (points**2).sum(1), k)
                inertia += np.bincount(index, far, k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(list(np.column_stack([n, square, inertia, total])[some]), pa.list_(pa.float64()))], names=["cluster", "sums"])

    parts = rows.select("v").mapInArrow(add, "cluster int, sums array<double>").select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((k, d + 3))
    for r in parts.collect():  # k clusters times the length of a vector
        out[r["cluster"], r["at"]] = r["x"]
    return out[:, 0], out[:, 3:], out[:, 1], float(out[:, 2].sum())


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """k centers: rounds that take points with a chance in proportion to their squared distance, then the best of these by weight.

    Chances are drawn by a hash of the id, so every run takes the same. About ``OVERSAMPLE`` times k points are taken a round.
    """
    first = rows.orderBy(F.xxhash64("id"), "id").limit(1).collect()
    taken = np.array([r["v"] for r in first], dtype=float)
    for turn in range(SEED_ROUNDS):
        placed = assign(rows, taken)
        whole = placed.agg(F.sum("distance")).head()[0]
        if not whole:
            break
        chance = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        more = placed.where(chance < OVERSAMPLE * k * F.col("distance") / F.lit(whole)).orderBy("id").select("v").collect()
        if more:
            taken = np.unique(np.concatenate([taken, np.array([r["v"] for r in more], dtype=float)]), axis=0)
    weight = sums_of(rows, taken)[0]
    chosen = [int(np.argmax(weight))]
    far = ((taken - taken[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(taken)):
        chosen.append(int(np.argmax(weight * far)))
        far = np.minimum(far, ((taken - taken[chosen[-1]]) ** 2).sum(1))
    return taken[chosen]


def k_means(rows: DataFrame, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """(centers, inertia of every round, never rising) of ``rows`` (id, v: vectors of one length), which are read once a round. Clusters that lose all points keep their center."""
    centers, inertia = seeds(rows, k), []
    for _ in range(rounds):
        n, total, _, now = sums_of(rows, centers)
        if inertia and now >= inertia[-1] * (1 - 1e-9):
            break
        inertia.append(now)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers, inertia


def silhouette(rows: DataFrame, centers: np.ndarray) -> float:
    """Mean silhouette by squared distances. A point's mean squared distance to a cluster follows from the cluster's sums, so no pairs are made; a point alone counts 0."""
    n, total, square, _ = sums_of(rows, centers)
    if (n > 0).sum() < 2:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast((centers, n, total, square))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, n, total, square = shared.value
        for batch in batches:
            points = _points(batch.column("v")) if batch.num_rows else np.zeros((0, centers.shape[1]))
            index, _ = _nearest(points, centers)
            far = n * (points**2).sum(1)[:, None] - 2 * points @ total.T + square  # sums of squared distances to all points of a cluster
            own = np.arange(len(points)), index
            inside = far[own] / np.maximum(n[index] - 1, 1)
            mean = np.where(n > 0, far / np.maximum(n, 1), np.inf)
            mean[own] = np.inf
            outside = mean.min(1)
            s = np.where(n[index] > 1, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    return float(rows.select("v").mapInArrow(judge, "s double").agg(F.avg("s")).head()[0])


def best_clusters(vectors: DataFrame, id: str, vector: str, most: int = 5) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(id, cluster, distance) for the number of clusters from 2 to ``most`` with the highest silhouette, and the silhouettes. Null vectors are left out; clusters are numbered by size, largest first."""
    path = work_folder(vectors.sparkSession, "clusters")
    vectors.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).write.parquet(path)
    rows = vectors.sparkSession.read.parquet(path)
    tried = []
    for k in range(2, most + 1):
        centers, _ = k_means(rows, k)
        tried.append((silhouette(rows, centers), -k, centers))
    score, _, centers = max(tried, key=lambda x: x[:2])
    n = sums_of(rows, centers)[0]
    centers = centers[np.argsort(-n, kind="stable")]
    return assign(rows, centers).select(F.col("id").alias(id), "cluster", "distance"), [(-k, s) for s, k, _ in tried]
