"""Falsification of trading signals: resampling per series in Arrow-backed functions, gates as columns.

A series is a few thousand returns, so a group fits a task; many series or candidate parameters spread over tasks.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sharpe(r: np.ndarray, periods: int = 252) -> float:
    """0 for two values or fewer."""
    return float(r.mean() / (r.std(ddof=1) + 1e-12) * np.sqrt(periods)) if len(r) > 2 else 0.0


def bootstrap_p(r: np.ndarray, block: int = 10, n: int = 500, seed: int = 1) -> float:
    """Share of block-resampled demeaned series whose mean reaches the observed one."""
    if len(r) < block:
        return 1.0
    rng = np.random.default_rng(seed)
    centred, need = r - r.mean(), -(-len(r) // block)
    starts = rng.integers(0, len(r) - block + 1, (n, need))
    means = centred[(starts[:, :, None] + np.arange(block)).reshape(n, -1)[:, : len(r)]].mean(axis=1)
    return float((1 + (means >= r.mean()).sum()) / (n + 1))


def deflated_sharpe(r: np.ndarray, trials: int = 10) -> float:
    """Probability that the Sharpe ratio beats the best of ``trials`` lucky ones, skew and kurtosis counted."""
    n = len(r)
    if n < 10 or r.std() == 0:
        return 0.0
    normal = NormalDist()
    s, z = r.mean() / r.std(ddof=1), (r - r.mean()) / r.std()
    skew, kurtosis = float((z**3).mean()), float((z**4).mean())
    spread = np.sqrt((1 - skew * s + (kurtosis - 1) / 4 * s * s) / (n - 1))
    euler = 0.5772156649015329
    luck = spread * ((1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * np.e))) if trials > 1 else 0.0
    return float(normal.cdf((s - luck) / spread))


def shift_null_p(signal: np.ndarray, forward: np.ndarray, n: int = 200, seed: int = 7) -> float:
    """Share of circular shifts of the signal whose rank correlation with what follows is as strong."""
    if len(signal) < 20:
        return 1.0
    a, b = (pd.Series(x).rank().to_numpy() for x in (signal, forward))
    a, b = (a - a.mean()) / (a.std() or 1), (b - b.mean()) / (b.std() or 1)
    shifts = np.random.default_rng(seed).integers(10, len(a) - 9, n)
    real = abs((a * b).mean())
    return float((1 + sum(abs((np.roll(a, k) * b).mean()) >= real for k in shifts)) / (n + 1))


def judge(returns: DataFrame) -> DataFrame:
    """ticker, n, sharpe, p_bootstrap, p_shift, deflated, verdict from columns ticker, d, r (return) and s (signal before it)."""

    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d").dropna(subset=["r", "s"])
        r, s = pdf["r"].to_numpy(dtype=float), pdf["s"].to_numpy(dtype=float)
        net = np.sign(s) * r
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "n": [len(r)], "sharpe": [sharpe(net)], "p_bootstrap": [bootstrap_p(net)], "p_shift": [shift_null_p(s, r)], "deflated": [deflated_sharpe(net)]}) if len(pdf) else pd.DataFrame(columns=["ticker", "n", "sharpe", "p_bootstrap", "p_shift", "deflated"])

    got = returns.select("ticker", "d", "r", "s").groupBy("ticker").applyInPandas(per_ticker, "ticker string, n long, sharpe double, p_bootstrap double, p_shift double, deflated double")
    passed = (F.col("p_bootstrap") < 0.1).cast("int") + (F.col("p_shift") < 0.1).cast("int") + (F.col("deflated") > 0.9).cast("int")
    return got.withColumn("verdict", F.when(passed == 3, "SURVIVES").when(passed > 0, "WOUNDED").otherwise("FALSIFIED"))


def first_component(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, absorption: share of variance on the first principal axis, from sums of outer products.

    The d x d sums are added up row by row in Spark with partial sums; only they reach the eigenvalue step.
    """
    x = rows.select(F.col(group).alias("g"), F.posexplode(vector).alias("i", "x"), F.col(vector).alias("v"))
    cells = x.select("g", "i", "x", F.posexplode("v").alias("j", "y")).where("i <= j").groupBy("g", "i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"), F.sum(F.col("x").cast("double")).alias("sx"), F.sum(F.col("y").cast("double")).alias("sy"), F.count("*").alias("n"))

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        d, n = int(pdf["j"].max()) + 1, int(pdf["n"].max())
        c = np.zeros((d, d))
        c[pdf["i"], pdf["j"]] = pdf["xy"] / n - pdf["sx"] * pdf["sy"] / n / n
        c = np.triu(c) + np.triu(c, 1).T
        values = np.linalg.eigvalsh(c)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [n], "absorption": [float(values[-1] / max(values.sum(), 1e-300))]})

    return cells.groupBy("g").applyInPandas(eigen, "g string, n long, absorption double").withColumnRenamed("g", group)
