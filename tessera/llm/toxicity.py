"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed stems of words (their first bytes, and how often a text has them) learns from texts known to be toxic and from texts of unknown class. With
the class prior p, the risk of calling unlabelled text toxic is corrected for the toxic texts hidden in it and
never lets the corrected part fall below zero: ``p R+(positive) + max(0, R-(unlabelled) - p R-(positive))``.
A text's margin is that of its highest window of 100 words, less what the highest of so many clean windows rises above one by chance: the tail of clean
windows is exponential at some rate, so their highest grows by the logarithm of their number over that rate. So the margin does not grow with the length
or the vocabulary of clean text. A line fitted on the margins of labelled texts then turns the margin into a probability.

Whole texts of all rows are scored, in windows that overlap by half. Null and empty texts get the score of a text without features. Rows that
repeat are scored each. Without a single toxic label every score is 0. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.features import Adam, row_sums, sigmoid, stems, window_stems
from tessera.llm.sampling import first_by_hash, held_out, sample_features, stack
from tessera.llm.scratch import bounded_batches

#: Training samples: toxic, other labelled (for the line only) and unlabelled documents.
MOST_TOXIC, MOST_OTHER, MOST_UNLABELLED = 4000, 4000, 4000
THRESHOLD = 0.7
#: Cells of the table of features.
BITS = 22
#: A window of a text is twice this many words, and the next one begins this many words later.
HALF_WINDOW = 50
#: Margins of windows are counted in this many bins of this width around 0.
BINS, BIN = 4000, 0.02
#: The tail of clean windows are those above this quantile.
TAIL_FROM = 0.9


@dataclass
class ToxicityModel:
    weights: np.ndarray
    slope: float
    offset: float
    rise: float = 0.0  # of the highest clean window with the logarithm of the number of windows

    def score(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margin + self.offset) if self.slope else np.zeros(len(margin))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The highest margin of a window of each text, less its rise by chance."""
        out = np.zeros(len(texts))
        for lo, hi, first, n, window, feature in window_stems(texts, BITS, HALF_WINDOW):
            out[lo:hi] = np.maximum.reduceat(row_sums(window, self.weights[feature], first[-1] + n[-1]), first) - self.rise * np.log(n)
        return out

    def tail(self, texts: pa.Array) -> np.ndarray:
        """How many windows of the texts have their margin in each bin of ``BIN``."""
        out = np.zeros(BINS, dtype=np.int64)
        for _, _, first, n, window, feature in window_stems(texts, BITS, HALF_WINDOW):
            margin = row_sums(window, self.weights[feature], first[-1] + n[-1])
            out += np.bincount(np.clip(np.floor(margin / BIN) + BINS // 2, 0, BINS - 1).astype(np.int64), minlength=BINS)
        return out


def _texts_with(rows: list, size: int) -> np.ndarray:
    """How many texts have each feature."""
    out = np.zeros(size, dtype=np.int64)
    for lo in range(0, len(rows), 500):
        feature, n = np.unique(np.concatenate([f for f, _ in rows[lo : lo + 500]]), return_counts=True)
        out[feature] += n
    return out


def fit_nnpu(positive, unlabelled, prior: float, size: int, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4, least: int = 5, smooth: float = 4.0, telling: float = 0.3) -> np.ndarray:
    """Weights of a linear classifier by the non-negative risk.

    A feature's value is the smoothed log of how much oftener positive texts hold it than chance has it, so that
    chance findings count little. Features in fewer than ``least`` sample texts, or with a value of under ``telling``,
    stay out; so do all that speak against toxicity, as the clean words around a toxic passage would outweigh it.
    """
    of_positive, of_other = (_texts_with(x, size) for x in (positive, unlabelled))
    total = of_positive + of_other
    value = np.log((of_positive + smooth) / (total * len(positive) / (len(positive) + len(unlabelled)) + smooth))
    common = (total >= least) & (value >= telling)
    new = np.cumsum(common) - 1
    (prow, pf), (urow, uf) = (stack([(f[common[f]], c[:0]) for f, c in x])[:2] for x in (positive, unlabelled))
    rows, feats = [prow, urow], [new[pf], new[uf]]
    d, value = int(common.sum()), value[common]
    w, b = np.zeros(d), 0.0
    step_w, step_b = Adam(d, rate), Adam((), rate)
    n = [len(positive), len(unlabelled)]
    for _ in range(rounds):
        fp, fu = (row_sums(r, (w * value)[f], k) + b for r, f, k in zip(rows, feats, n))
        # logistic loss: as toxic log(1+exp(-f)), as clean log(1+exp(f))
        clean_p, clean_u = np.logaddexp(0, fp).mean(), np.logaddexp(0, fu).mean()
        gp, gu = -prior * sigmoid(-fp) / n[0], np.zeros(n[1])
        if clean_u - prior * clean_p >= 0:
            gp, gu = gp - prior * sigmoid(fp) / n[0], sigmoid(fu) / n[1]
        else:  # the corrected part went negative: undo it
            gp, gu = prior * sigmoid(fp) / n[0], -sigmoid(fu) / n[1]
        g = value * sum(np.bincount(f, x[r], minlength=d) for r, f, x in zip(rows, feats, (gp, gu))) + decay * w
        w, b = step_w.step(w, g), float(step_b.step(np.float64(b), gp.sum() + gu.sum()))
    full = np.zeros(size, dtype=np.float32)
    full[common] = w * value
    return full


def fit_line(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic line by Newton's method, with smoothed targets."""
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    scale = margin.std() or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w), -2, 2)
    return float(max(w[0], 1e-6) / scale), float(w[1])


def train_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on documents that are not held out: bounded samples, chosen by a hash of the id."""
    bounded_batches(docs.sparkSession)
    learnable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in learnable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0)
    prior = n[1] / sum(n.values())
    known = first_by_hash(learnable.where("toxic = 1"), MOST_TOXIC, 1).unionByName(first_by_hash(learnable.where("toxic = 0"), MOST_OTHER, 2))
    rest = first_by_hash(docs.select("doc_id").where("doc_id is not null").where(~held_out(F.col("doc_id"))), MOST_UNLABELLED, 3).distinct().withColumn("toxic", F.lit(-1))
    rows = sample_features(docs, known.where("toxic = 1").unionByName(rest), stems, BITS)
    positive, unlabelled = ([(f, c) for t, f, c in rows if t == k] for k in (1, -1))
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0)
    model = ToxicityModel(fit_nnpu(positive, unlabelled, prior, 1 << BITS), 1.0, 0.0)
    model.rise = _rise(docs, known, model)
    margin, label = _labelled_margins(docs, known, model)
    model.slope, model.offset = fit_line(margin, label)
    return model


def mean_excess(counts: np.ndarray) -> float:
    """Mean by which margins in the tail pass the quantile at which it begins; 0 without a tail."""
    upto, middle = np.cumsum(counts), (np.arange(BINS) - BINS // 2 + 0.5) * BIN
    if not upto[-1]:
        return 0.0
    begin = int(np.searchsorted(upto, TAIL_FROM * upto[-1]))
    above = counts[begin + 1 :]
    return float((above * (middle[begin + 1 :] - middle[begin])).sum() / above.sum()) if above.sum() else 0.0


def _rise(docs: DataFrame, known: DataFrame, model: ToxicityModel) -> float:
    """Mean excess of the windows of the clean documents of ``known``, from counts that Spark adds up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            total += shared.value.tail(batch.column(0))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(total[some])], names=["bin", "n"])

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known.where("toxic = 0")), "doc_id").select("text")
    counts = np.zeros(BINS, dtype=np.int64)
    for r in rows.mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    return mean_excess(counts)


def _labelled_margins(docs: DataFrame, known: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Margins and labels of the documents of ``known``, in an order that is the same at every run."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.margins(batch.column(1)))], names=["toxic", "margin"])

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("toxic", "text")
    got = np.array(sorted((r["margin"], r["toxic"]) for r in rows.mapInArrow(margins, "toxic int, margin double").collect()))
    return got[:, 0], got[:, 1]


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.7 on) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            s = shared.value.score(shared.value.margins(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that score below the threshold, all their columns kept."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(shared.value.margins(batch.column(at))) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
