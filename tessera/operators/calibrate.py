"""Thresholds and parameters chosen on events: all leave-one-event-out scores, ablations and grids from sums, without a loop over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rolling_z(value: str, key: str, order: str, rows: int = 60, least: int = 20) -> Column:
    """(value - mean) / standard deviation of the last ``rows`` rows of a key, from ``least`` values on; null where they do not vary."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= least, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def events_of(days: DataFrame, key: str, order: str, truth: str, fuzz: int = 3) -> DataFrame:
    """``days`` with event (number of the stretch of true days that a day is in, else null), near_first and near_last (events within ``fuzz`` days; null if none is)."""
    along = Window.partitionBy(key).orderBy(order)
    begins = F.col(truth) & ~F.coalesce(F.lag(truth).over(along), F.lit(False))
    numbered = days.withColumn("event", F.when(F.col(truth), F.sum(begins.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))))
    around = along.rowsBetween(-fuzz, fuzz)
    return numbered.withColumn("near_first", F.min("event").over(around)).withColumn("near_last", F.max("event").over(around))


def leave_one_event_out(days: DataFrame, key: str, order: str, truth: str, score: str, grid: list[float], cost: float = 2.0, fuzz: int = 3) -> DataFrame:
    """key, event, days, threshold, objective, recall: for each event the threshold that the other events choose, and the share of the event's days above it.

    The objective of a threshold is the recall on the days of the training events less ``cost`` times the share of signals on days
    that are not within ``fuzz`` days of one; the first threshold of the largest objective is taken (the first of all where there is no other event).
    With an event left out, its days leave the recall, and days that only it is near join the quiet ones: both are totals less or plus that event's part.
    A null score is no signal.
    """
    levels = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(len(grid))]).alias("i"), F.array(*[F.lit(float(g)) for g in grid]).alias("threshold")))
    tried = events_of(days, key, order, truth, fuzz).select(F.col(key).alias("key"), "event", "near_first", "near_last", F.col(score).alias("score"), levels.alias("g"))
    on = F.coalesce(F.col("score") > F.col("g.threshold"), F.lit(False)).cast("long")
    only = F.when(F.col("near_first") == F.col("near_last"), F.col("near_first"))
    held = tried.select("key", "g.i", "g.threshold", "event", only.alias("only"), F.col("near_first").isNull().alias("quiet"), on.alias("on"))
    at = ["key", "i", "threshold"]
    totals = held.groupBy(*at).agg(F.sum(F.when(F.col("event").isNotNull(), F.col("on"))).alias("hits"), F.count("event").alias("n"), F.sum(F.when(F.col("quiet"), F.col("on"))).alias("false"), F.sum(F.col("quiet").cast("long")).alias("calm"))
    of_event = held.where("event is not null").groupBy(*at, "event").agg(F.sum("on").alias("e_hits"), F.count("*").alias("e_n"))
    of_only = held.where("only is not null").groupBy(*at, F.col("only").alias("event")).agg(F.sum("on").alias("o_on"), F.count("*").alias("o_n"))
    parts = of_event.join(of_only, [*at, "event"], "left").join(totals, at)
    other = F.col("n") - F.col("e_n")
    false = (F.coalesce("false", F.lit(0)) + F.coalesce("o_on", F.lit(0))) / F.nullif(F.col("calm") + F.coalesce("o_n", F.lit(0)), F.lit(0))
    judged = parts.withColumn("objective", (F.col("hits") - F.col("e_hits")) / F.nullif(other, F.lit(0)) - cost * F.coalesce(false, F.lit(0.0)))
    best = judged.groupBy("key", "event").agg(F.max(F.struct(F.coalesce("objective", F.lit(float("-inf"))).alias("o"), (-F.col("i")).alias("first"), "threshold", "objective", "e_hits", "e_n")).alias("b"))
    return best.select(F.col("key").alias(key), "event", F.col("b.e_n").alias("days"), F.col("b.threshold").alias("threshold"), F.col("b.objective").alias("objective"), (F.col("b.e_hits") / F.col("b.e_n")).alias("recall"))


def ablation(days: DataFrame, key: str, truth: str, factors: list[str], threshold: float) -> DataFrame:
    """key, factor, loss: recall of the mean of all factors above ``threshold`` less that without the factor. Null factors leave a mean over the others, as does the one left out."""
    total = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in factors), F.lit(0.0))
    count = sum((F.col(f).isNotNull().cast("int") for f in factors), F.lit(0))
    hit = lambda s, n: F.avg(F.when(F.col(truth), F.coalesce(F.try_divide(s, n) > threshold, F.lit(False)).cast("int")))
    without = [hit(total - F.coalesce(F.col(f), F.lit(0.0)), count - F.col(f).isNotNull().cast("int")).alias(f) for f in factors]
    recalls = days.groupBy(F.col(key).alias(key)).agg(hit(total, count).alias("full_"), *without)
    return recalls.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), (F.col("full_") - F.col(f)).alias("loss")) for f in factors])).alias("x")).select(key, "x.factor", "x.loss")


def grid_search(days: DataFrame, key: str, order: str, factors: list[str], target: str, smoothing: list[int], weights: dict[str, list[float]]) -> DataFrame:
    """key, smoothing, scheme, n, correlation, rank: every smoothing (mean of so many rows) and weighting of the factors by its correlation with ``target``, best first.

    The parameters are a table joined to the series; ties and missing correlations rank in the order given. Rows with a null factor or target do not count.
    """
    smooth = days.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(target).alias("target"), F.array(*[
        F.array(*[F.avg(f).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - s, 0)) for f in factors]) for s in smoothing
    ]).alias("means"))
    table = days.sparkSession.createDataFrame([(i, j, s, name, [float(x) for x in w]) for i, s in enumerate(smoothing) for j, (name, w) in enumerate(weights.items())], "i int, j int, smoothing int, scheme string, w array<double>")
    tried = smooth.crossJoin(F.broadcast(table))  # a row of the series for each parameter set, of which there are a handful
    score = F.aggregate(F.zip_with(F.get("means", F.col("i")), "w", lambda m, w: m * w), F.lit(0.0), lambda a, x: a + x)
    scored = tried.withColumn("score", score).where("score is not null and target is not null")
    found = scored.groupBy("key", "i", "j", "smoothing", "scheme").agg(F.count("*").alias("n"), F.corr("score", "target").alias("correlation"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_last(F.round("correlation", 12)), "i", "j"))
    return found.select(F.col("key").alias(key), "smoothing", "scheme", "n", "correlation", rank.alias("rank"))
