"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds cut the line between them:
``P(grade <= k) = sigmoid(threshold_k - w.x)``. That gives each text an expected grade and the probability of
reaching the top grade, by which texts are selected.

Whole texts of all rows are scored; null and empty texts have no features. Grades may be any integers, of which
the distinct values count as ranks. With fewer than two grades among the labels every text gets that one grade
(or 0 without labels) and tail probability 1. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.features import BITS, Adam, hashed, row_sums, sigmoid
from tessera.llm.sampling import first_by_hash, held_out, sample_features, stack
from tessera.llm.scratch import bounded_batches

#: Training sample per grade; more different grades than the second are an error.
MOST_PER_GRADE, MOST_GRADES = 4000, 100


@dataclass
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the top grade)."""
        if not len(self.thresholds):
            return np.full(len(x), float(self.grades[0])), np.ones(len(x))
        below = sigmoid(self.thresholds[None, :] - x[:, None])
        p = np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], 1), axis=1)
        return p @ self.grades, p[:, -1]

    def project(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, doc, feature, count in hashed(texts):
            value, n = np.log1p(count), hi - lo
            norm = np.sqrt(row_sums(doc, value * value, n))
            out[lo:hi] = row_sums(doc, self.weights[feature] * value, n) / np.maximum(norm, 1e-12)
        return out


def fit_ordinal(rows: list, rank: np.ndarray, k: int, size: int, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean log-likelihood; ``rank`` runs from 0 to k-1, each rank with equal weight."""
    row, feature, count = stack(rows)
    value = np.log1p(count)
    value /= np.sqrt(row_sums(row, value * value, len(rows)))[row]
    used, at = np.unique(feature, return_inverse=True)
    common = np.bincount(at, minlength=len(used)) >= least
    keep = common[at]
    row, at, value, d = row[keep], (np.cumsum(common) - 1)[at[keep]], value[keep], int(common.sum())
    share = (1 / np.bincount(rank, minlength=k).clip(1))[rank] / k
    w = np.zeros(d)
    free = np.r_[0.0, np.zeros(k - 2)]  # the first threshold, then logs of the gaps
    step_w, step_t = Adam(d, rate), Adam(k - 1, rate)
    for _ in range(rounds):
        gaps = np.exp(free[1:])
        theta = free[0] + np.r_[0.0, np.cumsum(gaps)]
        x = row_sums(row, w[at] * value, len(rows))
        edge = np.r_[-np.inf, theta, np.inf]
        hi, lo = sigmoid(edge[rank + 1] - x), sigmoid(edge[rank] - x)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p * share, lo * (1 - lo) / p * share
        g = np.bincount(at, (dhi - dlo)[row] * value, minlength=d) + decay * w
        gt = np.zeros(k + 1)
        np.add.at(gt, rank + 1, -dhi)
        np.add.at(gt, rank, dlo)
        gt = gt[1:-1]
        gfree = np.r_[gt.sum(), [gt[i + 1 :].sum() * gaps[i] for i in range(k - 2)]]
        w, free = step_w.step(w, g), step_t.step(free, gfree)
    full = np.zeros(size, dtype=np.float32)
    full[used[common]] = w
    return full, free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]


def train_quality(docs: DataFrame, labels: DataFrame, rating: str = "quality") -> QualityModel:
    """Fit on documents that are not held out: a bounded sample of each grade, chosen by a hash of the id."""
    learnable = labels.where(F.col("doc_id").isNotNull() & F.col(rating).isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(rating).cast("int").alias("grade"))
    grades = sorted(r["grade"] for r in learnable.select("grade").distinct().limit(MOST_GRADES + 1).collect())
    if len(grades) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} different grades")
    flat = QualityModel(np.zeros(1 << BITS, dtype=np.float32), np.zeros(0), np.array(grades[:1] or [0], dtype=float))
    if len(grades) < 2:
        return flat
    chosen = None
    for g in grades:
        part = first_by_hash(learnable.where(F.col("grade") == g), MOST_PER_GRADE, 7)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = sample_features(docs, chosen)
    if len({r[0] for r in rows}) < len(grades):
        grades = sorted({r[0] for r in rows})
        if len(grades) < 2:
            return flat
    rank = np.searchsorted(grades, [r[0] for r in rows])
    weights, thresholds = fit_ordinal([r[1:] for r in rows], rank, len(grades), 1 << BITS)
    return QualityModel(weights, thresholds, np.array(grades, dtype=float))


def score_quality(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, selected (tail probability at least ``least``) for each row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            grade, tail = shared.value.grade(shared.value.project(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grade), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "held_out", "expected_grade", "tail_probability", "selected"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, expected_grade double, tail_probability double, selected boolean")
