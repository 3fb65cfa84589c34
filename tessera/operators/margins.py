"""A linear margin classifier learned in Spark rounds, and probabilities from its margins by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import work_folder

#: Cells of hashed words, rounds, strength of the pull to zero, and width of the bins in which margins are calibrated.
CELLS, ROUNDS, DECAY, BIN = 1024, 40, 1e-3, 0.01


def hashed_words(text: Column, cells: int = CELLS) -> Column:
    """Cells of the words of a text, one entry a word; a null text has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(cells)).cast("int"))


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    """Rows of counts, each divided by its length, and a constant."""
    n = np.asarray(cells.value_lengths().fill_null(0))
    out = np.zeros((len(cells), width + 1))
    np.add.at(out, (np.repeat(np.arange(len(cells)), n), cells.flatten().to_numpy(zero_copy_only=False)), 1.0)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1.0)
    out[:, -1] = 1.0
    return out


def train_margins(rows: DataFrame, rounds: int = ROUNDS, width: int = CELLS) -> np.ndarray:
    """Weights by steps down the hinge loss of all rows (``cells``, ``label`` 1 or -1), the classes weighing alike.

    Each round sends the weights out and adds up the rows within their margin, one partial sum a task; the steps shrink as one over the round
    (the step of Pegasos, with all rows as its sample), and the weights returned are the mean of the second half.
    """
    path = work_folder(rows.sparkSession, "margins")
    rows.select("cells", "label").write.parquet(path)  # read once a round
    rows = rows.sparkSession.read.parquet(path)
    share = rows.agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") < 0).alias("n")).head()
    if not share["p"] or not share["n"]:
        return np.zeros(width + 1)
    weights, mean = np.zeros(width + 1), np.zeros(width + 1)
    for turn in range(1, rounds + 1):
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + 1)
            for batch in batches:
                label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                x = _matrix(batch.column(0), width)
                inside = label * (x @ shared.value) < 1
                total += (np.where(label > 0, 0.5 / share["p"], 0.5 / share["n"]) * label * inside) @ x
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(total[some])], names=["cell", "x"])

        pull = np.zeros(width + 1)
        for r in rows.mapInArrow(add, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # as many as there are cells
            pull[r["cell"]] = r["x"]
        weights = (1 - 1 / turn) * weights + pull / (DECAY * turn)
        weights *= min(1.0, 1 / (np.sqrt(DECAY) * max(np.linalg.norm(weights), 1e-12)))
        if turn > rounds // 2:
            mean += weights / (rounds - rounds // 2)
    return mean


def score_margins(rows: DataFrame, weights: np.ndarray, cells: str = "cells") -> DataFrame:
    """``rows`` with margin in the place of ``cells``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    others = [c for c in rows.columns if c != cells]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _matrix(batch.column(cells), len(shared.value) - 1) @ shared.value
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(margin)], names=[*others, "margin"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(score, ", ".join([*(f"{c} {kinds[c]}" for c in others), "margin double"]))


def pool_adjacent(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The never falling sequence nearest to ``mean`` by squares weighted by ``n``: neighbours that fall are pooled."""
    blocks: list[list[float]] = []  # weight, mean, length
    for w, m in zip(n, mean):
        blocks.append([float(w), float(m), 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2]
    return np.repeat([m for _, m, _ in blocks], [k for _, _, k in blocks]) if blocks else np.zeros(0)


def calibrate(scored: DataFrame) -> list[tuple[float, float]]:
    """(margin from which on, probability), rising, from ``scored`` (margin, label).

    Margins are counted in bins of a hundredth between -20 and 20, so what reaches the driver does not grow with the rows; then neighbours are pooled.
    """
    at = F.floor(F.least(F.greatest("margin", F.lit(-20.0)), F.lit(20.0)) / BIN)
    bins = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("label") > 0).cast("int")).alias("p")).orderBy("bin").collect()
    p = pool_adjacent(np.array([r["n"] for r in bins]), np.array([r["p"] for r in bins]))
    return [(r["bin"] * BIN, float(x)) for k, (r, x) in enumerate(zip(bins, p)) if k == 0 or x > p[k - 1]]


def probability(margin: Column, steps: list[tuple[float, float]]) -> Column:
    """The step that a margin has reached; the lowest below all, null without steps."""
    if not steps:
        return F.lit(None).cast("double")
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(p).alias("p")) for a, p in steps])
    return F.coalesce(F.try_element_at(F.filter(table, lambda s: s["a"] <= margin), F.lit(-1))["p"], F.lit(steps[0][1]))  # no entry reached: null, not an error
