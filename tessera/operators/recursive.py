"""Indicators with memory of the whole past: exponential means, Wilder smoothing, reversals.

A window frame cannot refer to its own previous value, so each ticker's series goes to one Arrow-backed function. A
series has a row per trading day, a few ten thousand in a century, which bounds the group; tickers spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ema(s: pd.Series, n: int) -> pd.Series:
    return s.ewm(span=n, adjust=False).mean()


def wilder(s: pd.Series, n: int) -> pd.Series:
    return s.ewm(alpha=1 / n, adjust=False).mean()


def rsi(c: pd.Series, n: int) -> pd.Series:
    """Null where nothing fell so far."""
    step = c.diff()
    rise, fall = wilder(step.clip(lower=0).iloc[1:], n), wilder(-step.clip(upper=0).iloc[1:], n)
    return (100 - 100 / (1 + rise / fall.where(fall != 0))).reindex(c.index)


def directional(high: pd.Series, low: pd.Series, close: pd.Series, n: int) -> pd.DataFrame:
    """ATR, +DI, -DI and ADX by Wilder's smoothing. Movements begin with the second bar, and so do the indicators made of them."""
    earlier = close.shift().fillna(close)
    reach = np.maximum(high, earlier.where(close.shift().notna(), high)) - np.minimum(low, earlier.where(close.shift().notna(), low))
    atr = wilder(reach, n)
    step = pd.DataFrame({"plus_di": high.diff(), "minus_di": -low.diff()})
    ahead = step.gt(step[["minus_di", "plus_di"]].to_numpy()) & step.gt(0)
    di = step.where(ahead | step.isna(), 0.0).apply(wilder, n=n).mul(100).div(atr.where(atr != 0), axis=0)
    total = di["plus_di"] + di["minus_di"]
    spread = 100 * (di["plus_di"] - di["minus_di"]).abs() / total.where(total != 0)
    return di.assign(atr=atr, adx=wilder(spread, n))


def indicators(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, n: int = 14) -> DataFrame:
    """ticker, d, ema, macd, macd_signal, macd_hist, rsi, atr, natr, plus_di, minus_di, adx."""

    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", ignore_index=True)
        c = pdf["close"]
        line = ema(c, fast) - ema(c, slow)
        sig = ema(line, signal)
        out = pdf[["ticker", "d"]].assign(ema=ema(c, fast), macd=line, macd_signal=sig, macd_hist=line - sig, rsi=rsi(c, n))
        out = out.join(directional(pdf["high"], pdf["low"], c, n))
        return out.assign(natr=100 * out["atr"] / c)[["ticker", "d", "ema", "macd", "macd_signal", "macd_hist", "rsi", "atr", "natr", "plus_di", "minus_di", "adx"]]

    numbers = ", ".join(f"{c} double" for c in ("ema", "macd", "macd_signal", "macd_hist", "rsi", "atr", "natr", "plus_di", "minus_di", "adx"))
    return panel.select("ticker", "d", "high", "low", "close").groupBy("ticker").applyInPandas(per_ticker, f"ticker string, d date, {numbers}")


def pivots(panel: DataFrame, threshold: float) -> DataFrame:
    """ticker, d, kind (H or L), price: turning points confirmed by a reversal of ``threshold``."""

    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", ignore_index=True)
        c, rows, way, best = pdf["close"].to_numpy(), [], 0, 0
        for i in range(1, len(c)):
            if way >= 0 and c[i] > c[best] or way <= 0 and c[i] < c[best]:
                if way == 0:
                    way = 1 if c[i] > c[best] else -1
                best = i
            elif way == 1 and c[i] <= c[best] * (1 - threshold) or way == -1 and c[i] >= c[best] * (1 + threshold):
                rows.append((best, "H" if way == 1 else "L"))
                way, best = -way, i
        at = np.array([r[0] for r in rows], dtype=int)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[at].to_numpy(), "d": pdf["d"].iloc[at].to_numpy(), "kind": [r[1] for r in rows], "price": c[at]})

    return panel.select("ticker", "d", "close").groupBy("ticker").applyInPandas(per_ticker, "ticker string, d date, kind string, price double")


def robust_z(panel: DataFrame, c: str, least: int = 30, floor: float = 0.001, at: float = 3.0, n: int = 21) -> DataFrame:
    """ticker, d, expanding, rolling: z-scores by medians.

    ``expanding`` is (x - median) / max(IQR / 1.349, floor) of all rows so far, clipped, from ``least`` rows on;
    ``rolling`` is (x - median) / (1.4826 MAD) of the last n rows, 0 where the MAD is 0. Sorting each frame anew in SQL
    costs the square of the series; here quantiles are kept up as rows come.
    """

    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", ignore_index=True)
        x = pdf[c]
        so_far = x.expanding(least)
        low, mid, high = (so_far.quantile(q) for q in (0.25, 0.5, 0.75))
        expanding = ((x - mid) / ((high - low) / 1.349).clip(lower=floor)).clip(-at, at)
        rolling = np.full(len(x), np.nan)
        if len(x) >= n:
            frames = np.lib.stride_tricks.sliding_window_view(x.to_numpy(dtype=float), n)
            median = np.median(frames, axis=1)
            mad = 1.4826 * np.median(np.abs(frames - median[:, None]), axis=1)
            gap = x.to_numpy(dtype=float)[n - 1 :] - median
            rolling[n - 1 :] = np.where(np.isnan(median), np.nan, np.divide(gap, mad, out=np.zeros_like(gap), where=mad != 0))
        return pdf[["ticker", "d"]].assign(expanding=expanding, rolling=rolling)

    return panel.select("ticker", "d", c).groupBy("ticker").applyInPandas(per_ticker, "ticker string, d date, expanding double, rolling double")
