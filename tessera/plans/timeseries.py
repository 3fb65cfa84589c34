"""Price-panel queries. The panel stands in for market data: tickers are order classes, a bar is a day of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import recursive, significance
from tessera.operators import windows as w
from tessera.plans.registry import Tables, query

PANEL = """
    panel AS (
        SELECT o_orderstatus || substr(o_orderpriority, 1, 1) AS ticker, CAST(o_orderdate AS DATE) AS d,
               arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
               arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume,
               CASE WHEN count(*) % 3 = 0 THEN NULL ELSE arg_max(o_totalprice, o_orderkey) * 0.5 END AS adj_close
        FROM orders GROUP BY 1, 2)"""


def panel(t: Tables) -> DataFrame:
    ticker = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("ticker")
    close = F.max_by("o_totalprice", "o_orderkey")
    return t.orders.groupBy(ticker, F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), close.alias("close"),
        F.count("*").cast("double").alias("volume"), F.when(F.count("*") % 3 != 0, close * 0.5).alias("adj_close"),
    )


def _out(df: DataFrame, digits: int = 4, **columns) -> DataFrame:
    return df.select("ticker", "d", *[F.round(c, digits).alias(k) for k, c in columns.items()])


def _sql(columns: str, more: str = "", source: str = "panel", n: str = "") -> str:
    return f"WITH {PANEL}{more} SELECT ticker, d, {columns} FROM {source} {n}"


def _over(n: int, f: str, of: str = "close") -> str:
    frame = f"(PARTITION BY ticker ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) OVER {frame} >= {n} THEN {f} OVER {frame} END"


_ORDER, _PAST = "(PARTITION BY ticker ORDER BY d)", "(PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)"


@query(_sql("round(open * f, 4) AS open, round(high * f, 4) AS high, round(low * f, 4) AS low, round(coalesce(adj_close, close), 4) AS close", ", x AS (SELECT *, coalesce(adj_close / close, 1) AS f FROM panel)", "x"))
def adjusted_prices(t: Tables) -> DataFrame:
    """PRJ-02: open, high and low scaled by adj_close / close."""
    f = F.coalesce(F.try_divide("adj_close", "close"), F.lit(1.0))
    return _out(panel(t), open=F.col("open") * f, high=F.col("high") * f, low=F.col("low") * f, close=F.coalesce("adj_close", "close"))


@query(_sql(f"round({_over(5, 'avg(close)')}, 4) AS sma5, round({_over(20, 'avg(close)')}, 4) AS sma20"))
def sma(t: Tables) -> DataFrame:
    """WN-01"""
    return _out(panel(t), sma5=w.sma("close", 5), sma20=w.sma("close", 20))


@query(_sql(f"round({_over(20, 'avg(close)')} - 2 * {_over(20, 'stddev_pop(close)')}, 4) AS lower, round({_over(20, 'avg(close)')} + 2 * {_over(20, 'stddev_pop(close)')}, 4) AS upper"))
def bollinger(t: Tables) -> DataFrame:
    """WN-11"""
    m, s = w.sma("close", 20), w.deviation("close", 20)
    return _out(panel(t), lower=m - 2 * s, upper=m + 2 * s)


@query(
    f"""WITH {PANEL}, k AS (SELECT ticker, d, 100 * (close - {_over(14, 'min(low)', 'low')}) / nullif({_over(14, 'max(high)', 'high')} - {_over(14, 'min(low)', 'low')}, 0) AS raw FROM panel),
    s AS (SELECT ticker, d, {_over(3, 'avg(raw)', 'raw')} AS k FROM k)
    SELECT ticker, d, round(k, 4) AS k, round({_over(3, 'avg(k)', 'k')}, 4) AS dd FROM s"""
)
def stochastic(t: Tables) -> DataFrame:
    """WN-05"""
    k = panel(t).withColumn("raw", w.raw_stochastic(14)).withColumn("k", w.sma("raw", 3))
    return _out(k, k=F.col("k"), dd=w.sma("k", 3))


@query(_sql(f"round(-100 * ({_over(14, 'max(high)', 'high')} - close) / nullif({_over(14, 'max(high)', 'high')} - {_over(14, 'min(low)', 'low')}, 0), 4) AS wr"))
def williams_r(t: Tables) -> DataFrame:
    """WN-06"""
    return _out(panel(t), wr=w.williams(14))


@query(
    f"""WITH {PANEL}, x AS (SELECT ticker, d, (high + low + close) / 3 AS p FROM panel),
    y AS (SELECT ticker, d, p, {_over(20, 'list(p)', 'p')} AS l, {_over(20, 'avg(p)', 'p')} AS m FROM x)
    SELECT ticker, d, round((p - m) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) / 20, 0), 3) AS cci FROM y"""
)
def cci(t: Tables) -> DataFrame:
    """WN-07"""
    return _out(panel(t).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3), 3, cci=w.cci(20))


@query(_sql(f"round(close - lag(close, 10) OVER {_ORDER}, 4) AS mom, round((close / lag(close, 10) OVER {_ORDER} - 1) * 100, 4) AS roc"))
def momentum(t: Tables) -> DataFrame:
    """WN-08"""
    return _out(panel(t), mom=w.momentum("close", 10), roc=100 * w.simple_return("close", 10))


@query(_sql(f"round(sum(s * volume) OVER {_PAST}, 4) AS obv", f", x AS (SELECT *, coalesce(sign(close - lag(close) OVER {_ORDER}), 0) AS s FROM panel)", "x"))
def obv(t: Tables) -> DataFrame:
    """WN-12"""
    return _out(panel(t).withColumn("step", F.col("close") - F.lag("close").over(w.ordered())), obv=w.obv())


@query(_sql("round((open + high + low + close) / 4, 4) AS avg_price, round((high + low) / 2, 4) AS median_price, round((high + low + close) / 3, 4) AS typical_price, round((high + low + 2 * close) / 4, 4) AS weighted_close"))
def price_transforms(t: Tables) -> DataFrame:
    """WN-13"""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return _out(panel(t), avg_price=(o + h + low + c) / 4, median_price=(h + low) / 2, typical_price=(h + low + c) / 3, weighted_close=(h + low + 2 * c) / 4)


@query(_sql("abs(close - open) <= 0.1 * (high - low) AND high > low AS doji, least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.5 * abs(close - open) AND close <> open AS hammer, "
            f"coalesce(lag(close) OVER {_ORDER} < lag(open) OVER {_ORDER} AND close > open AND open <= lag(close) OVER {_ORDER} AND close >= lag(open) OVER {_ORDER}, false) AS engulfing"))  # fmt: skip
def candlesticks(t: Tables) -> DataFrame:
    """WN-14: the patterns as predicates on this and the previous bar."""
    o, c, body = F.col("open"), F.col("close"), F.abs(F.col("close") - F.col("open"))
    po, pc = F.lag("open").over(w.ordered()), F.lag("close").over(w.ordered())
    return panel(t).select(
        "ticker", "d", ((body <= 0.1 * (F.col("high") - F.col("low"))) & (F.col("high") > F.col("low"))).alias("doji"),
        ((F.least(o, c) - F.col("low") >= 2 * body) & (F.col("high") - F.greatest(o, c) <= 0.5 * body) & (c != o)).alias("hammer"),
        F.coalesce((pc < po) & (c > o) & (o <= pc) & (c >= po), F.lit(False)).alias("engulfing"),
    )


@query(
    f"""WITH {PANEL}, x AS (SELECT ticker, d, close, max(close) OVER {_PAST} AS peak FROM panel),
    y AS (SELECT *, close / peak - 1 AS dd FROM x), low AS (SELECT ticker, arg_min(d, struct_pack(dd := dd, d := d)) AS trough, min(dd) AS dd, arg_min(peak, struct_pack(dd := dd, d := d)) AS peak FROM y GROUP BY ticker),
    top AS (SELECT l.ticker, max(p.d) AS peak_date FROM low l JOIN panel p ON p.ticker = l.ticker AND p.d <= l.trough AND p.close = l.peak GROUP BY 1),
    back AS (SELECT l.ticker, min(p.d) AS recovery FROM low l JOIN panel p ON p.ticker = l.ticker AND p.d > l.trough AND p.close >= l.peak GROUP BY 1)
    SELECT ticker, round(dd, 6) AS max_drawdown, peak_date, trough AS trough_date, recovery AS recovery_date, CAST(trough - peak_date AS BIGINT) AS days_down FROM low JOIN top USING (ticker) LEFT JOIN back USING (ticker)"""
)
def max_drawdown(t: Tables) -> DataFrame:
    """WN-16: the deepest fall, with its peak, trough and recovery dates."""
    x = panel(t).select("ticker", "d", "close", F.max("close").over(w.so_far()).alias("peak")).withColumn("dd", F.col("close") / F.col("peak") - 1)
    low = x.groupBy("ticker").agg(F.min(F.struct("dd", "d", "peak")).alias("low")).select("ticker", "low.dd", F.col("low.d").alias("trough_date"), F.col("low.peak").alias("top"))
    y = x.select("ticker", "d", "close").join(low, "ticker")
    return y.groupBy("ticker").agg(
        F.round(F.first("dd"), 6).alias("max_drawdown"), F.max(F.when((F.col("d") <= F.col("trough_date")) & (F.col("close") == F.col("top")), F.col("d"))).alias("peak_date"),
        F.first("trough_date").alias("trough_date"), F.min(F.when((F.col("d") > F.col("trough_date")) & (F.col("close") >= F.col("top")), F.col("d"))).alias("recovery_date"),
    ).withColumn("days_down", F.datediff("trough_date", "peak_date").cast("long"))


@query(_sql(f"round(100 * close / first_value(close) OVER {_PAST}, 4) AS rebased"))
def rebase_100(t: Tables) -> DataFrame:
    """WN-17"""
    return _out(panel(t), rebased=w.rebase("close"))


@query(_sql(f"round(close / lag(close) OVER {_ORDER} - 1, 6) AS simple, round(ln(close / lag(close) OVER {_ORDER}), 6) AS logarithmic"))
def returns(t: Tables) -> DataFrame:
    """WN-18"""
    return _out(panel(t), 6, simple=w.simple_return("close"), logarithmic=w.log_return("close"))


@query(_sql(f"round({_over(20, 'corr(high, close)')}, 5) AS correlation"))
def rolling_correlation(t: Tables) -> DataFrame:
    """WN-19"""
    return _out(panel(t), 5, correlation=w.rolling_correlation("high", "close", 20))


_R = f"r AS (SELECT ticker, d, close / lag(close) OVER {_ORDER} - 1 AS r FROM panel)"


def _returns(t: Tables) -> DataFrame:
    return panel(t).select("ticker", "d", w.simple_return("close").alias("r"))


@query(
    f"""WITH {PANEL}, {_R}, s AS (SELECT ticker, lag, d, CASE WHEN lag >= 0 THEN r END AS r, l AS lag FROM r, (SELECT unnest([-3, -1, 0, 1, 3]) AS l) WHERE false),
    b AS (SELECT d, r, row_number() OVER (ORDER BY d) AS i FROM r WHERE ticker = 'F1'),
    j AS (SELECT a.ticker, k.lag, a.r AS x, b2.r AS y FROM r a JOIN b ON a.d = b.d, (SELECT unnest([-3, -1, 0, 1, 3]) AS lag) k JOIN b b2 ON b2.i = b.i - k.lag WHERE a.ticker <> 'F1')
    SELECT ticker, CAST(lag AS INT) AS lag, round(corr(x, y), 5) AS correlation, count(x + y) AS n FROM j WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""".replace("s AS (SELECT ticker, lag, d, CASE WHEN lag >= 0 THEN r END AS r, l AS lag FROM r, (SELECT unnest([-3, -1, 0, 1, 3]) AS l) WHERE false),\n    ", "")
)
def lead_lag(t: Tables) -> DataFrame:
    """WN-20: correlation of each ticker's return with the leader's, k of the leader's days before."""
    r = _returns(t)
    day = Window.orderBy("d")  # one ticker's days: bounded by the calendar
    leader = r.where("ticker = 'F1'").select("d", *[F.lag("r", k).over(day).alias(f"k{k}") for k in (-3, -1, 0, 1, 3)])
    long = r.where("ticker <> 'F1'").join(leader, "d").unpivot(["ticker", "d", "r"], [f"k{k}" for k in (-3, -1, 0, 1, 3)], "lag", "y").where("r is not null and y is not null")
    return long.groupBy("ticker", F.expr("cast(substr(lag, 2) as int)").alias("lag")).agg(F.round(F.corr("r", "y"), 5).alias("correlation"), F.count("*").alias("n"))


@query(
    f"""WITH {PANEL}, x AS (SELECT ticker, d, close * volume AS dv, close, volume FROM panel)
    SELECT ticker, d, round(dv, 6) AS dollar_volume, round(avg(dv) OVER (PARTITION BY ticker ORDER BY d ROWS 4 PRECEDING), 6) AS ma5, round(avg(dv) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), 6) AS ma20,
           round(dv / avg(dv) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), 5) AS ratio, round(close / lag(close, 5) OVER {_ORDER} - 1, 6) AS r5, round(volume / lag(volume) OVER {_ORDER} - 1, 6) AS volume_change FROM x"""
)
def fund_flow(t: Tables) -> DataFrame:
    """WN-21: dollar volume with means over up to 5 and 20 rows."""
    x = panel(t).withColumn("dv", F.col("close") * F.col("volume"))
    ma = lambda n: F.avg("dv").over(w.frame(n))
    return x.select("ticker", "d", F.round("dv", 6).alias("dollar_volume"), F.round(ma(5), 6).alias("ma5"), F.round(ma(20), 6).alias("ma20"), F.round(F.try_divide(F.col("dv"), ma(20)), 5).alias("ratio"), F.round(w.simple_return("close", 5), 6).alias("r5"), F.round(w.simple_return("volume"), 6).alias("volume_change"))


@query(
    f"""WITH {PANEL}, x AS (SELECT a.ticker, a.d, a.close / b.close AS rs FROM panel a JOIN panel b ON a.d = b.d AND b.ticker = 'F1'),
    y AS (SELECT *, {_over(10, 'avg(rs)', 'rs')} AS ma FROM x) SELECT ticker, d, round(rs, 5) AS rs, round(ma, 5) AS ma10, round(ma - lag(ma, 5) OVER {_ORDER}, 5) AS trend FROM y"""
)
def relative_strength(t: Tables) -> DataFrame:
    """WN-22 and JN-05: price against the benchmark's on the same day."""
    p = panel(t)
    bench = p.where("ticker = 'F1'").select("d", F.col("close").alias("b"))
    x = p.join(bench, "d").select("ticker", "d", F.try_divide("close", "b").alias("rs")).withColumn("ma", w.sma("rs", 10))
    return _out(x, 5, rs=F.col("rs"), ma10=F.col("ma"), trend=w.momentum("ma", 5))


@query(f"WITH {PANEL} SELECT d, round(avg(CASE WHEN ticker LIKE 'F%' THEN close END) / avg(CASE WHEN ticker LIKE 'O%' THEN close END), 5) AS risk_ratio, CASE WHEN avg(CASE WHEN ticker LIKE 'F%' THEN close END) > avg(CASE WHEN ticker LIKE 'O%' THEN close END) THEN 'RISK_ON' ELSE 'RISK_OFF' END AS signal FROM panel GROUP BY d")
def composite_signals(t: Tables) -> DataFrame:
    """WN-23 and PRJ-08: signals of a day from several tickers."""
    f, o = (F.avg(F.when(F.col("ticker").startswith(k), F.col("close"))) for k in "FO")
    return panel(t).groupBy("d").agg(F.round(F.try_divide(f, o), 5).alias("risk_ratio"), F.when(f > o, "RISK_ON").otherwise("RISK_OFF").alias("signal"))


@query(_sql("round(CASE WHEN count(close) OVER f >= 20 THEN close / avg(close) OVER f * 166 END, 2) AS maintenance", n="WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING)"))
def margin_proxy(t: Tables) -> DataFrame:
    """WN-24"""
    return _out(panel(t), 2, maintenance=w.full(F.try_divide(F.col("close"), F.avg("close").over(w.frame(60))) * 166, "close", 60, 20))


@query(_sql(f"round((close / lag(close, 12) OVER {_ORDER} - 1) * 100, 4) AS yoy, round(close - lag(close) OVER {_ORDER}, 4) AS diff, round(close / sum(close) OVER (PARTITION BY d), 6) AS share"))
def macro_transforms(t: Tables) -> DataFrame:
    """WN-25: change over a season, difference, share of the day's total."""
    return panel(t).select("ticker", "d", F.round(100 * w.simple_return("close", 12), 4).alias("yoy"), F.round(w.momentum("close", 1), 4).alias("diff"), F.round(F.try_divide(F.col("close"), F.sum("close").over(Window.partitionBy("d"))), 6).alias("share"))


@query(_sql(f"round(last_value(adj_close IGNORE NULLS) OVER {_PAST}, 4) AS filled"))
def forward_fill(t: Tables) -> DataFrame:
    """WN-26"""
    return _out(panel(t), filled=w.forward_fill("adj_close"))


@query(
    f"""WITH {PANEL}, x AS (SELECT ticker, d, close, count(*) OVER {_PAST} AS n, quantile_cont(close, 0.25) OVER {_PAST} AS a, quantile_cont(close, 0.5) OVER {_PAST} AS b, quantile_cont(close, 0.75) OVER {_PAST} AS c FROM panel)
    SELECT ticker, d, round(CASE WHEN n >= 30 THEN greatest(-3.0, least(3.0, (close - b) / greatest((c - a) / 1.349, 0.001))) END, 5) AS z FROM x"""
)
def expanding_robust_z(t: Tables) -> DataFrame:
    """WN-27"""
    return _out(recursive.robust_z(panel(t), "close"), 5, z=F.col("expanding"))


@query(
    f"""WITH {PANEL}, x AS (SELECT ticker, d, close, {_over(21, 'list(close)')} AS l, {_over(21, 'median(close)')} AS m FROM panel),
    y AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - m))) AS mad FROM x)
    SELECT ticker, d, round(CASE WHEN m IS NOT NULL THEN coalesce((close - m) / nullif(1.4826 * mad, 0), 0) END, 5) AS z FROM y"""
)
def rolling_robust_z(t: Tables) -> DataFrame:
    """WN-28"""
    return _out(recursive.robust_z(panel(t), "close"), 5, z=F.col("rolling"))


@query(_sql("round(CASE WHEN count(close) OVER f >= 20 THEN greatest(-2.5, least(2.5, (close - avg(close) OVER f) / nullif(stddev_samp(close) OVER f, 0))) END, 5) AS z", n="WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING)"))
def rolling_z(t: Tables) -> DataFrame:
    """WN-29"""
    return _out(panel(t), 5, z=w.clipped(w.rolling_z("close", 60, 20), 2.5))


@query(_sql("round((rank() OVER (PARTITION BY d ORDER BY close) + (count(*) OVER (PARTITION BY d, close) - 1) / 2.0) / count(*) OVER (PARTITION BY d), 6) AS pct, round((close - avg(close) OVER (PARTITION BY d)) / nullif(stddev_samp(close) OVER (PARTITION BY d), 0), 5) AS z"))
def cross_section(t: Tables) -> DataFrame:
    """WN-30"""
    day = Window.partitionBy("d")
    return panel(t).select("ticker", "d", F.round(w.average_rank_share("close", "d"), 6).alias("pct"), F.round(F.try_divide(F.col("close") - F.avg("close").over(day), F.stddev_samp("close").over(day)), 5).alias("z"))


@query(
    f"""WITH {PANEL}, x AS (SELECT ticker, d, close / max(close) OVER {_PAST} - 1 AS dd FROM panel),
    y AS (SELECT *, dd <= {_over(60, 'quantile_cont(dd, 0.1)', 'dd')} OR dd < -0.9 AS gate FROM x)
    SELECT ticker, d, round(dd, 6) AS dd, coalesce(gate, false) AS gate, max(CAST(coalesce(gate, false) AS INT)) OVER (PARTITION BY ticker ORDER BY d ROWS 4 PRECEDING) = 1 AS held FROM y"""
)
def drawdown_gate(t: Tables) -> DataFrame:
    """WN-31: a gate on the rolling quantile of drawdowns or a deep one, held for five rows."""
    x = panel(t).withColumn("dd", w.drawdown("close"))
    low = w.full(F.percentile("dd", F.lit(0.1)).over(w.frame(60)), "dd", 60)
    x = x.withColumn("gate", F.coalesce((F.col("dd") <= low) | (F.col("dd") < -0.9), F.lit(False)))
    return x.select("ticker", "d", F.round("dd", 6).alias("dd"), "gate", w.any_of_last("gate", 5).alias("held"))


@query(_sql("max(CAST(close > 450000 AS INT)) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near, coalesce(sum(CAST(close > 300000 AS INT)) OVER (PARTITION BY ticker ORDER BY d ROWS 2 PRECEDING) >= 2, false) AS persistent"))
def fuzzy_and_persistence(t: Tables) -> DataFrame:
    """WN-32 and WN-37"""
    x = panel(t).withColumn("f", F.col("close") > 450000).withColumn("g", F.col("close") > 300000)
    return x.select("ticker", "d", w.near_any("f", 3).alias("near"), w.at_least_hits("g", 2, 3).alias("persistent"))


@query(f"""WITH {PANEL}, x AS (SELECT ticker, d, close, {_over(30, 'list(close)')} AS l FROM panel)
    SELECT ticker, d, round(100.0 * len(list_filter(l, lambda v: v <= close)) / 30, 4) AS score, round(100 - 100.0 * len(list_filter(l, lambda v: v <= close)) / 30, 4) AS inverse FROM x""")  # fmt: skip
def percent_rank_score(t: Tables) -> DataFrame:
    """WN-33"""
    s = w.rolling_percent_score("close", 30)
    return _out(panel(t), score=s, inverse=100 - s)


@query(
    f"""WITH {PANEL}, z AS (SELECT ticker, d, (close - avg(close) OVER f) / nullif(stddev_samp(close) OVER f, 0) AS z FROM panel WINDOW f AS (PARTITION BY d))
    SELECT a.d, round(100 * tanh(sum(greatest(0, a.z) * greatest(0, b.z)) / 1.5), 5) AS gfi FROM z a JOIN z b ON a.d = b.d AND b.ticker = 'F1' AND a.ticker <> 'F1' WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY a.d"""
)
def quadrant_index(t: Tables) -> DataFrame:
    """WN-34 and FN-20: products of positive z-scores with the benchmark's, squashed."""
    day = Window.partitionBy("d")
    z = panel(t).select("ticker", "d", F.try_divide(F.col("close") - F.avg("close").over(day), F.stddev_samp("close").over(day)).alias("z")).where("z is not null")
    b = z.where("ticker = 'F1'").select("d", F.col("z").alias("b"))
    product = F.greatest(F.lit(0.0), "z") * F.greatest(F.lit(0.0), "b")
    return z.where("ticker <> 'F1'").join(b, "d").groupBy("d").agg(F.round(100 * F.tanh(F.sum(product) / 1.5), 5).alias("gfi"))


@query(_sql(f"round(CASE WHEN adj_close IS NOT NULL AND lag(close, 3) OVER {_ORDER} IS NOT NULL THEN 0.6 * close / 1000 + 0.4 * adj_close / 1000 END, 4) AS composite"))
def weighted_composite(t: Tables) -> DataFrame:
    """WN-35: null unless every part is there."""
    present = F.col("adj_close").isNotNull() & F.lag("close", 3).over(w.ordered()).isNotNull()
    return _out(panel(t), composite=F.when(present, 0.6 * F.col("close") / 1000 + 0.4 * F.col("adj_close") / 1000))


@query(_sql(f"round(lead(close, 5) OVER {_ORDER} / close - 1, 6) AS forward"))
def forward_return(t: Tables) -> DataFrame:
    """WN-36"""
    return _out(panel(t), 6, forward=w.forward_return("close", 5))


@query(
    f"""WITH {PANEL}, {_R}, s AS (SELECT ticker, d, r, CASE WHEN lag(r) OVER {_ORDER} > 0 THEN 1.0 WHEN lag(r) OVER {_ORDER} < 0 THEN -1.0 ELSE 0.0 END AS pos FROM r),
    p AS (SELECT *, pos / nullif(sum(abs(pos)) OVER (PARTITION BY d), 0) AS wt FROM s)
    SELECT d, round(sum(coalesce(wt, 0) * coalesce(r, 0)), 6) AS portfolio, round(sum(abs(coalesce(wt, 0))), 6) AS gross FROM p GROUP BY d"""
)
def portfolio_returns(t: Tables) -> DataFrame:
    """WN-38: yesterday's sign as position, weights normed per day."""
    s = _returns(t).withColumn("pos", F.coalesce(F.signum(F.lag("r").over(w.ordered())), F.lit(0.0)))
    s = s.withColumn("wt", F.coalesce(F.try_divide(F.col("pos"), F.sum(F.abs("pos")).over(Window.partitionBy("d"))), F.lit(0.0)))
    return s.groupBy("d").agg(F.round(F.sum(F.col("wt") * F.coalesce("r", F.lit(0.0))), 6).alias("portfolio"), F.round(F.sum(F.abs("wt")), 6).alias("gross"))


@query(
    f"""WITH {PANEL}, {_R}, c AS (SELECT unnest([0.0, 5.0, 10.0, 25.0]) AS bps), n AS (SELECT ticker, bps, r - bps / 10000 AS net FROM r, c WHERE r IS NOT NULL)
    SELECT ticker, CAST(bps AS DOUBLE) AS bps, round(CASE WHEN count(*) > 2 THEN avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) ELSE 0 END, 5) AS sharpe FROM n GROUP BY 1, 2"""
)
def cost_sweep(t: Tables) -> DataFrame:
    """WN-39 and AG-20: the Sharpe ratio at several costs."""
    net = _returns(t).where("r is not null").withColumn("bps", F.explode(F.array(*map(F.lit, (0.0, 5.0, 10.0, 25.0))))).withColumn("net", F.col("r") - F.col("bps") / 10000)
    sharpe = F.when(F.count("*") > 2, F.avg("net") / (F.stddev_samp("net") + 1e-12) * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return net.groupBy("ticker", "bps").agg(F.round(sharpe, 5).alias("sharpe"))


@query(
    f"""WITH {PANEL}, {_R}, v AS (SELECT ticker, d, r, {_over(20, 'stddev_samp(r)', 'r')} AS vol FROM r), m AS (SELECT ticker, quantile_cont(vol, 0.5) AS med FROM v GROUP BY 1)
    SELECT ticker, vol > med AS high_volatility, count(*) AS n, round(avg(r) / (stddev_samp(r) + 1e-12) * sqrt(252), 5) AS sharpe FROM v JOIN m USING (ticker) WHERE vol IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2"""
)
def regime_split(t: Tables) -> DataFrame:
    """WN-40: rows before the first full frame are in neither regime."""
    v = _returns(t).withColumn("vol", w.deviation("r", 20, sample=True))
    med = v.groupBy("ticker").agg(F.percentile("vol", F.lit(0.5)).alias("med"))
    x = v.join(med, "ticker").where("vol is not null and r is not null")
    return x.groupBy("ticker", (F.col("vol") > F.col("med")).alias("high_volatility")).agg(F.count("*").alias("n"), F.round(F.avg("r") / (F.stddev_samp("r") + 1e-12) * F.sqrt(F.lit(252.0)), 5).alias("sharpe"))


@query(
    f"""WITH {PANEL}, {_R}, k AS (SELECT *, row_number() OVER {_ORDER} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM r WHERE r IS NOT NULL),
    f AS (SELECT *, least(4, i // greatest(1, n // 5)) AS fold FROM k) SELECT ticker, CAST(fold AS BIGINT) AS fold, count(*) AS n, round(avg(r) / (stddev_samp(r) + 1e-12) * sqrt(252), 5) AS sharpe
    FROM f WHERE fold = 0 OR i - fold * greatest(1, n // 5) >= 5 GROUP BY 1, 2"""
)
def folds_with_embargo(t: Tables) -> DataFrame:
    """WN-41: five folds in order of time; the first five rows of every later fold are left out."""
    k = _returns(t).where("r is not null").withColumn("i", F.row_number().over(w.ordered()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("ticker")))
    size = F.greatest(F.lit(1), F.expr("n div 5"))
    f = k.withColumn("size", size).withColumn("fold", F.least(F.lit(4), F.expr("i div size"))).where((F.col("fold") == 0) | (F.col("i") - F.col("fold") * F.col("size") >= 5))
    return f.groupBy("ticker", "fold").agg(F.count("*").alias("n"), F.round(F.avg("r") / (F.stddev_samp("r") + 1e-12) * F.sqrt(F.lit(252.0)), 5).alias("sharpe"))


@query(
    f"""WITH {PANEL}, m AS (SELECT ticker, d, close / lag(close, 20) OVER {_ORDER} - 1 AS mom FROM panel), days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM panel)),
    pick AS (SELECT m.ticker, days.i FROM m JOIN days USING (d) WHERE i % 20 = 0 AND mom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m.d ORDER BY mom DESC, ticker) <= 3)
    SELECT days.d, pick.ticker FROM days JOIN pick ON pick.i = days.i - days.i % 20"""
)
def rotation(t: Tables) -> DataFrame:
    """WN-42: the three strongest of each rebalance day, held to the next."""
    m = panel(t).select("ticker", "d", w.simple_return("close", 20).alias("mom"))
    days = m.select("d").distinct().withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)  # a calendar: a few thousand rows
    best = m.join(days, "d").where("i % 20 = 0 and mom is not null").withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("mom"), "ticker"))).where("k <= 3").select("ticker", F.col("i").alias("at"))
    return days.join(best, F.col("at") == F.col("i") - F.col("i") % 20).select("d", "ticker")


@query(
    f"""WITH {PANEL}, span AS (SELECT ticker, min(d) AS a, max(d) AS b FROM panel GROUP BY 1), want AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
    SELECT ticker, d FROM want WHERE isodow(d) <= 5 EXCEPT SELECT ticker, d FROM panel"""
)
def missing_business_days(t: Tables) -> DataFrame:
    """WN-44"""
    p = panel(t).select("ticker", "d")
    want = p.groupBy("ticker").agg(F.explode(F.sequence(F.min("d"), F.max("d"))).alias("d")).where("weekday(d) < 5")
    return want.join(p, ["ticker", "d"], "left_anti")


@query("""WITH x AS (SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) + 1 AS d FROM events)
    SELECT event_id, CAST(CASE isodow(d) WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END AS DATE) AS trading_day FROM x""")  # fmt: skip
def event_alignment(t: Tables) -> DataFrame:
    """WN-45: the next trading day in UTC+8, weekends skipped."""
    d = F.date_add(F.to_date(F.expr("ts + interval 8 hours")), 1)
    return t.events.select("event_id", d.alias("d")).select("event_id", F.when(F.weekday("d") == 5, F.date_add("d", 2)).when(F.weekday("d") == 6, F.date_add("d", 1)).otherwise(F.col("d")).alias("trading_day"))


@query(
    f"""WITH {PANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM panel)
    SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS last, max(CASE WHEN k = 2 THEN close END) AS prev, round(max(CASE WHEN k = 1 THEN volume END) / avg(CASE WHEN k <= 20 THEN volume END), 5) AS volume_ratio,
    round(max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 6 THEN close END) - 1, 6) AS perf5, round(max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 21 THEN close END) - 1, 6) AS perf20 FROM x GROUP BY ticker"""
)
def kpi_tiles(t: Tables) -> DataFrame:
    """WN-46"""
    x = panel(t).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where("k <= 21")
    at = lambda k, c="close": F.max(F.when(F.col("k") == k, F.col(c)))
    return x.groupBy("ticker").agg(
        at(1).alias("last"), at(2).alias("prev"), F.round(at(1, "volume") / F.avg(F.when(F.col("k") <= 20, F.col("volume"))), 5).alias("volume_ratio"),
        F.round(at(1) / at(6) - 1, 6).alias("perf5"), F.round(at(1) / at(21) - 1, 6).alias("perf20"),
    )


@query(f"WITH {PANEL} SELECT CAST(isodow(d) - 1 AS INT) AS weekday, round(avg(CASE WHEN year(d) = 1996 THEN close END), 3) AS y1996, round(avg(CASE WHEN year(d) = 1997 THEN close END), 3) AS y1997 FROM panel WHERE year(d) IN (1996, 1997) GROUP BY 1")
def calendar_heatmap(t: Tables) -> DataFrame:
    """WN-47: a pivot with its columns given."""
    p = panel(t).select(F.weekday("d").alias("weekday"), F.year("d").alias("y"), "close").where("y in (1996, 1997)")
    got = p.groupBy("weekday").pivot("y", [1996, 1997]).agg(F.avg("close"))
    return got.select("weekday", F.round("1996", 3).alias("y1996"), F.round("1997", 3).alias("y1997"))


@query("SELECT event_type, n, round(100.0 * sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def pareto(t: Tables) -> DataFrame:
    """WN-50: after the grouping one row per category is left."""
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("cumulative", F.round(100.0 * F.sum("n").over(Window.orderBy(F.desc("n"), "event_type").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()), 4))


@query("SELECT event_id, round(0.9 * pow(0.5, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') / 30.0), 6) AS confidence FROM events")
def confidence_decay(t: Tables) -> DataFrame:
    """WN-51 and DT-05: half of it gone every thirty days."""
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    return t.events.select("event_id", F.round(0.9 * F.pow(F.lit(0.5), age / 30.0), 6).alias("confidence"))


def _recursive_sql(start: str, step: str, out: str) -> str:
    return f"""WITH RECURSIVE {PANEL}, p AS MATERIALIZED (SELECT *, row_number() OVER {_ORDER} AS i, close - lag(close) OVER {_ORDER} AS step FROM panel),
    e AS ({start} UNION ALL {step}) {out}"""


@query(
    _recursive_sql(
        "SELECT ticker, d, i, close AS f, close AS s, CAST(0 AS DOUBLE) AS g FROM p WHERE i = 1",
        "SELECT p.ticker, p.d, p.i, e.f + 2.0 / 13 * (p.close - e.f), e.s + 2.0 / 27 * (p.close - e.s), e.g + 2.0 / 10 * ((e.f + 2.0 / 13 * (p.close - e.f)) - (e.s + 2.0 / 27 * (p.close - e.s)) - e.g) FROM e JOIN p ON p.ticker = e.ticker AND p.i = e.i + 1",
        "SELECT ticker, d, round(f, 4) AS ema, round(f - s, 4) AS macd, round(g, 4) AS macd_signal, round(f - s - g, 4) AS macd_hist FROM e",
    )
)
def macd(t: Tables) -> DataFrame:
    """WN-02 and WN-04"""
    return _out(recursive.indicators(panel(t)), ema=F.col("ema"), macd=F.col("macd"), macd_signal=F.col("macd_signal"), macd_hist=F.col("macd_hist"))


@query(
    _recursive_sql(
        "SELECT ticker, d, i, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS v FROM p WHERE i = 1",
        "SELECT p.ticker, p.d, p.i, coalesce(e.u + (greatest(p.step, 0) - e.u) / 14, greatest(p.step, 0)), coalesce(e.v + (greatest(-p.step, 0) - e.v) / 14, greatest(-p.step, 0)) FROM e JOIN p ON p.ticker = e.ticker AND p.i = e.i + 1",
        "SELECT ticker, d, round(100 - 100 / (1 + u / nullif(v, 0)), 4) AS rsi FROM e",
    )
)
def rsi(t: Tables) -> DataFrame:
    """WN-03"""
    return _out(recursive.indicators(panel(t)), rsi=F.col("rsi"))


_STEP = "(p.high - e.high)", "(e.low - p.low)"
_PLUS, _MINUS = f"CASE WHEN {_STEP[0]} > {_STEP[1]} AND {_STEP[0]} > 0 THEN {_STEP[0]} ELSE 0 END", f"CASE WHEN {_STEP[1]} > {_STEP[0]} AND {_STEP[1]} > 0 THEN {_STEP[1]} ELSE 0 END"


@query(f"""WITH RECURSIVE {PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM panel),
    e AS (SELECT ticker, d, i, high, low, close, high - low AS atr, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS v FROM p WHERE i = 1 UNION ALL
        SELECT p.ticker, p.d, p.i, p.high, p.low, p.close, e.atr + (greatest(p.high - p.low, abs(p.high - e.close), abs(p.low - e.close)) - e.atr) / 14,
            coalesce(e.u + (({_PLUS}) - e.u) / 14, {_PLUS}), coalesce(e.v + (({_MINUS}) - e.v) / 14, {_MINUS}) FROM e JOIN p ON p.ticker = e.ticker AND p.i = e.i + 1),
    x AS (SELECT *, 100 * u / nullif(atr, 0) AS pd, 100 * v / nullif(atr, 0) AS md FROM e), y AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM x),
    z AS (SELECT ticker, d, i, atr, close, pd, md, CAST(NULL AS DOUBLE) AS adx, 0 AS gap, i AS at FROM y WHERE i = 1 UNION ALL
        SELECT y.ticker, y.d, y.i, y.atr, y.close, y.pd, y.md, CASE WHEN y.dx IS NULL THEN z.adx WHEN z.adx IS NULL THEN y.dx ELSE (pow(13.0 / 14, z.gap + 1) * z.adx + y.dx / 14) / (pow(13.0 / 14, z.gap + 1) + 1.0 / 14) END,
            CASE WHEN y.dx IS NULL THEN z.gap + 1 ELSE 0 END, y.i FROM z JOIN y ON y.ticker = z.ticker AND y.i = z.i + 1)
    SELECT ticker, d, round(atr, 4) AS atr, round(100 * atr / close, 4) AS natr, round(pd, 4) AS plus_di, round(md, 4) AS minus_di, round(adx, 4) AS adx FROM z""")  # fmt: skip
def directional_movement(t: Tables) -> DataFrame:
    """WN-09 and WN-10"""
    return _out(recursive.indicators(panel(t)), **{c: F.col(c) for c in ("atr", "natr", "plus_di", "minus_di", "adx")})


@query()
def zigzag(t: Tables) -> DataFrame:
    """WN-15"""
    return recursive.pivots(panel(t), 0.5)


@query()
def signal_verdicts(t: Tables) -> DataFrame:
    """AG-21, AG-22, AG-24, CTL-03 and CTL-04: does yesterday's return foretell today's?"""
    r = _returns(t)
    return significance.judge(r.withColumn("s", F.lag("r").over(w.ordered())))


@query()
def absorption_ratio(t: Tables) -> DataFrame:
    """AG-17: the first principal axis of each label's vectors."""
    return significance.first_component(t.embeddings.withColumn("label", F.col("label").cast("string")), "label", "embedding")
