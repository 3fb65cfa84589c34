"""Time-series columns over a long panel (ticker, d, ...): frames by rows within each ticker in order of date.

All are plain window expressions, so one shuffle by ticker serves any number of them. Values are null until a
frame is full, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def frame(n: int, by="ticker", order="d"):
    """The last n rows, this one included."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def so_far(by="ticker", order="d"):
    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(by="ticker", order="d"):
    return Window.partitionBy(by).orderBy(order)


def full(value: Column, of: str, n: int, least: int | None = None) -> Column:
    """value where the frame holds at least ``least`` (or n) non-null rows."""
    return F.when(F.count(of).over(frame(n)) >= (least or n), value)


def sma(c: str, n: int) -> Column:
    return full(F.avg(c).over(frame(n)), c, n)


def deviation(c: str, n: int, sample: bool = False) -> Column:
    return full((F.stddev_samp if sample else F.stddev_pop)(c).over(frame(n)), c, n)


def highest(c: str, n: int) -> Column:
    return full(F.max(c).over(frame(n)), c, n)


def lowest(c: str, n: int) -> Column:
    return full(F.min(c).over(frame(n)), c, n)


def simple_return(c: str, n: int = 1) -> Column:
    return F.try_divide(F.col(c), F.lag(c, n).over(ordered())) - 1


def log_return(c: str) -> Column:
    return F.ln(F.try_divide(F.col(c), F.lag(c).over(ordered())))


def momentum(c: str, n: int) -> Column:
    return F.col(c) - F.lag(c, n).over(ordered())


def williams(n: int) -> Column:
    top, bottom = highest("high", n), lowest("low", n)
    return -100 * F.try_divide(top - F.col("close"), top - bottom)


def raw_stochastic(n: int) -> Column:
    top, bottom = highest("high", n), lowest("low", n)
    return 100 * F.try_divide(F.col("close") - bottom, top - bottom)


def cci(n: int, c: str = "typical") -> Column:
    """Distance from the mean in units of 0.015 mean absolute deviations."""
    values, mean = F.collect_list(c).over(frame(n)), F.avg(c).over(frame(n))
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / n
    return full(F.try_divide(F.col(c) - mean, 0.015 * spread), c, n)


def obv() -> Column:
    """Volume added on rising and taken off on falling closes; the first row counts nothing."""
    step = F.coalesce(F.signum(F.col("step")), F.lit(0.0)) * F.col("volume")
    return F.sum(step).over(so_far())


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rebase(c: str) -> Column:
    return 100 * F.try_divide(F.col(c), F.first(c, ignorenulls=True).over(so_far()))


def forward_fill(c: str) -> Column:
    return F.last(c, ignorenulls=True).over(so_far())


def forward_return(c: str, n: int) -> Column:
    return F.try_divide(F.lead(c, n).over(ordered()), F.col(c)) - 1


def rolling_z(c: str, n: int, least: int) -> Column:
    w = frame(n)
    return F.when(F.count(c).over(w) >= least, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)))


def clipped(x: Column, at: float) -> Column:
    """x within -at and at; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-at), F.least(F.lit(at), x)))


def rolling_correlation(x: str, y: str, n: int) -> Column:
    """Pearson correlation of a full frame; null where a side does not vary."""
    w = frame(n)
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w) >= n, F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


def rolling_percent_score(c: str, n: int) -> Column:
    """Share of a full frame that is not above the present value, times 100."""
    values = F.collect_list(c).over(frame(n))
    return full(100.0 * F.size(F.filter(values, lambda x: x <= F.col(c))) / n, c, n)


def average_rank_share(c: str, by: str) -> Column:
    """Average rank within ``by`` divided by the count, as data frames rank in per cent."""
    w = Window.partitionBy(by)
    ties = F.count(c).over(Window.partitionBy(by, c))
    return (F.rank().over(w.orderBy(c)) + (ties - 1) / 2.0) / F.count(c).over(w)


def drawdown(c: str) -> Column:
    return F.col(c) / F.max(c).over(so_far()) - 1


def any_of_last(flag: str, n: int) -> Column:
    return F.max(F.col(flag).cast("int")).over(frame(n)) == 1


def at_least_hits(flag: str, hits: int, n: int) -> Column:
    return F.sum(F.col(flag).cast("int")).over(frame(n)) >= hits


def near_any(flag: str, k: int, by="ticker", order="d") -> Column:
    """A flag within k rows either way."""
    return F.max(F.col(flag).cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(-k, k)) == 1
