"""Statistics of a panel of returns (ticker, d, r), scores of events, and links of tasks to parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import work_folder


def returns(panel: DataFrame) -> DataFrame:
    return panel.select("ticker", "d", (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("d")) - 1).alias("r"))


def risk_statistics(r: DataFrame, benchmark: str, windows: tuple[int, ...], year_start: str, rate: float) -> DataFrame:
    """Per ticker and window (last bars, or YTD): n, stddev_d, vol_ann, sharpe, beta, correl. Fewer than three returns give no row.

    Rows beyond the widest window and before the year are left out before they are dealt to windows.
    """
    k = r.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d"))))
    inside = [F.when(F.col("rn") <= w, F.lit(str(w))) for w in windows] + [F.when(F.col("d") >= year_start, "YTD")]
    dealt = k.where(f"rn <= {max(windows)} or d >= date'{year_start}'").where("r is not null").select("ticker", "d", "r", F.explode(F.array_compact(F.array(*inside))).alias("win"))
    b = dealt.where(F.col("ticker") == benchmark).select("d", "win", F.col("r").alias("b"))
    daily = (1 + rate) ** (1 / 252) - 1
    sd, enough = F.stddev_samp("r"), F.count("b") >= 3
    return dealt.join(b, ["d", "win"], "left").groupBy("ticker", "win").agg(
        F.count("*").alias("n"), F.round(sd, 6).alias("stddev_d"), F.round(sd * F.sqrt(F.lit(252.0)), 6).alias("vol_ann"), F.round((F.avg("r") - daily) / sd * F.sqrt(F.lit(252.0)), 4).alias("sharpe"),
        F.when(enough, F.round(F.regr_slope("r", "b"), 4)).alias("beta"), F.when(enough, F.round(F.corr("r", "b"), 4)).alias("correl"),
    ).where("n >= 3")


def snapshot(panel: DataFrame, price_bars: tuple[int, ...], volume_bars: tuple[int, ...], year_start: str, shares: int) -> DataFrame:
    """One row per ticker; the price is adj_close if the ticker has any, else close."""
    w = Window.partitionBy("ticker")
    p = F.when(F.count("adj_close").over(w) > 0, F.col("adj_close")).otherwise(F.col("close"))
    s = panel.select("ticker", "d", "volume", p.alias("p"), F.row_number().over(w.orderBy(F.desc("d"))).alias("rn"))
    mean = lambda c, n: F.when(F.count("*") >= n, F.round(F.avg(F.when(F.col("rn") <= n, F.col(c))), 4))
    last = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c)))
    first = F.min(F.when(F.col("d") >= year_start, F.struct("d", "p")))["p"]
    return s.groupBy("ticker").agg(
        *[mean("p", n).alias(f"sma_{n}") for n in price_bars], *[mean("volume", n).alias(f"avg_vol_{n}") for n in volume_bars],
        F.round((F.try_divide(last("p"), first) - 1) * 100, 4).alias("ytd_pct"), F.round(last("p"), 4).alias("adj_close"), last("volume").alias("volume"), F.round(last("p") * shares, 2).alias("market_cap"),
    )


def _with_market(r: DataFrame) -> DataFrame:
    return r.join(r.groupBy("d").agg(F.avg("r").alias("m")), "d").where("r is not null and m is not null")


def beta_removed(r: DataFrame) -> DataFrame:
    x = _with_market(r)
    beta = x.groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"))
    return x.join(beta, "ticker").select("ticker", "d", F.round(F.col("r") - F.col("beta") * F.col("m"), 6).alias("rest"))


def correlations(r: DataFrame, least: int = 3) -> DataFrame:
    """a, b, c for tickers a < b with so many common days."""
    r = r.where("r is not null")
    a, b = r.select(F.col("ticker").alias("a"), "d", F.col("r").alias("x")), r.select(F.col("ticker").alias("b"), "d", F.col("r").alias("y"))
    return a.join(b, "d").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def factor_alpha(r: DataFrame) -> DataFrame:
    """alpha, beta and the t-statistic of alpha in a regression on the market."""
    f = _with_market(r).groupBy("ticker").agg(F.count("*").alias("n"), F.regr_intercept("r", "m").alias("alpha"), F.regr_slope("r", "m").alias("beta"), F.regr_sxx("r", "m").alias("sxx"), F.regr_syy("r", "m").alias("syy"), F.regr_sxy("r", "m").alias("sxy"), F.regr_avgx("r", "m").alias("mx"))
    error = F.expr("sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0D / n + mx * mx / sxx))")
    return f.where("n > 2").select("ticker", F.round("alpha", 6).alias("alpha"), F.round("beta", 5).alias("beta"), F.round(F.try_divide("alpha", error), 4).alias("t"))


def daily_information(x: DataFrame, least: int) -> DataFrame:
    """days, mean_ic, sd, t from signals (s) and what followed (f)."""
    rank = lambda c: F.rank().over(Window.partitionBy("d").orderBy(c)) + (F.count("*").over(Window.partitionBy("d", c)) - 1) / 2.0
    k = x.where("s is not null and f is not null").select("d", rank("s").alias("a"), rank("f").alias("b"))
    ic = k.groupBy("d").agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))
    sd = F.stddev_samp("ic")
    return ic.agg(F.count("ic").alias("days"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(sd, 6).alias("sd"), F.round(F.avg("ic") / (sd / F.sqrt(F.count("ic"))), 4).alias("t"))


def event_scores(predicted: DataFrame, true: DataFrame, off: int) -> DataFrame:
    """ticker, prec, rec, f1 of bars (ticker, i); a bar is spread over its neighbours, which join by equality."""

    def hits(of: DataFrame, near: DataFrame, name: str) -> DataFrame:
        spread = near.select("ticker", F.explode(F.sequence(F.col("i") - off, F.col("i") + off)).alias("i")).distinct().withColumn("hit", F.lit(1))
        return of.join(spread, ["ticker", "i"], "left").groupBy("ticker").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias(name))

    x = hits(predicted, true, "prec").join(hits(true, predicted, "rec"), "ticker")
    f1 = F.coalesce(F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0))
    return x.select("ticker", F.round("prec", 6).alias("prec"), F.round("rec", 6).alias("rec"), F.round(f1, 6).alias("f1"))


def lagged_correlations(r: DataFrame, lags, least: int, calendar: DataFrame | None = None) -> DataFrame:
    """a, b, lag, n, c: b at ``lag`` bars of the common calendar after a; the calendar has a row per day, so numbering it is small."""
    days = (calendar or r).select("d").distinct()
    days = days.withColumn("i", F.row_number().over(Window.orderBy("d")))
    x = r.where("r is not null").join(F.broadcast(days), "d").select("ticker", "i", "r")
    a = x.select(F.col("ticker").alias("a"), F.col("r").alias("x"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("i") + k).alias("i")) for k in lags])).alias("at")).select("a", "x", "at.lag", "at.i")
    b = x.select(F.col("ticker").alias("b"), "i", F.col("r").alias("y"))
    return a.join(b, "i").where("a <> b").groupBy("a", "b", "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("c")).where(F.col("n") >= least)


def drawdown_recovery(panel: DataFrame) -> DataFrame:
    p = panel.select("ticker", "d", "close", F.max("close").over(Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))
    worst = p.groupBy("ticker").agg(F.min(F.struct((F.col("close") / F.col("peak") - 1).alias("dd"), "d", "peak")).alias("w"))
    x = p.join(worst, "ticker")
    at = F.max(F.when((F.col("d") <= F.col("w.d")) & (F.col("close") == F.col("w.peak")), F.col("d")))
    back = F.min(F.when((F.col("d") > F.col("w.d")) & (F.col("close") >= F.col("w.peak")), F.col("d")))
    f = x.groupBy("ticker", "w").agg(at.alias("peak_date"), back.alias("recovery_date"))
    return f.select("ticker", F.round("w.dd", 6).alias("drawdown"), "peak_date", F.col("w.d").alias("trough_date"), "recovery_date", F.datediff("w.d", "peak_date").alias("days_down"), F.datediff("recovery_date", "w.d").alias("days_up"))


def contained(tasks: DataFrame, key: str, name: str, parts: DataFrame, part: str, ident: str) -> DataFrame:
    """key, name, the smallest part whose ident occurs in the name. Lengths of idents are few."""
    lengths = [r[0] for r in parts.select(F.length(ident)).distinct().where(f"length({ident}) > 0").collect()]
    cut = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(F.col(name), i, F.lit(n))))
    pieces = [tasks.select(key, F.explode(F.array_distinct(cut(n))).alias(ident)) for n in lengths]
    found = reduce(DataFrame.unionByName, pieces).join(parts, ident).groupBy(key).agg(F.min(part).alias(part))
    return tasks.join(found, key, "left").select(key, name, part)


def on_cycles(edges: DataFrame) -> DataFrame:
    """task: every task that reaches itself along ``pred``.

    Ends of chains are peeled off. Of what is left, each task takes the smallest name that reaches it as its color; from each color's own task
    the cycle through it is walked back within the color, and goes. Both send one row an edge and round; pairs of tasks are never made.
    """
    spark, folder, n = edges.sparkSession, work_folder(edges.sparkSession, "cycles"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    def peeled(now: DataFrame) -> DataFrame:
        """Edges between tasks that have a predecessor and are one: others are on no cycle."""
        size = now.count()
        while size:
            now = kept(now.join(now.select(F.col("task").alias("pred")).distinct(), "pred", "left_semi").join(now.select(F.col("pred").alias("task")).distinct(), "task", "left_semi").select("task", "pred"))
            left = now.count()
            if left == size:
                break
            size = left
        return now

    now = kept(edges.where("task is not null and pred is not null").distinct())
    found = kept(now.where("task = pred").select("task").distinct())
    now = peeled(kept(now.where("task <> pred")))
    while now.head(1):
        color = kept(now.select("task").distinct().withColumn("color", F.col("task")))
        while True:  # the smallest name among a task and all that come before it
            passed = now.join(color.withColumnRenamed("task", "pred"), "pred").select("task", "color")
            after = kept(color.unionByName(passed).groupBy("task").agg(F.min("color").alias("color")))
            if not after.exceptAll(color).head(1):
                break
            color = after
        at = color.select(F.col("task").alias("pred"), F.col("color").alias("color_p"))
        within = kept(now.join(color, "task").join(at, "pred").where("color = color_p").select("task", "pred"))
        round_trip = kept(color.where("task = color").select("task"))
        size = round_trip.count()
        while True:  # what leads back to the color's own task
            round_trip = kept(round_trip.unionByName(within.join(round_trip, "task", "left_semi").select(F.col("pred").alias("task"))).distinct())
            left = round_trip.count()
            if left == size:
                break
            size = left
        # a color's own task is on a cycle if another of its color leads back to it
        alone = within.join(round_trip, "task", "left_semi").join(round_trip.select(F.col("task").alias("pred")), "pred", "left_semi").select("task").distinct()
        found = kept(found.unionByName(alone).distinct())
        now = peeled(kept(now.join(round_trip, "task", "left_anti").join(round_trip.select(F.col("task").alias("pred")), "pred", "left_anti").select("task", "pred")))
    return found
