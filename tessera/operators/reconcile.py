"""Cross-validation of two or more sources of the same facts: compare with tolerance, explain, agree, grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the larger of |a| and |b|; 0 where both are 0."""
    return F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def compare(first: DataFrame, second: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """keys, first, second, verdict: MATCH, MISMATCH, FIRST_ONLY or SECOND_ONLY of two frames with a column ``value``."""
    both = first.select(*keys, F.col("value").alias("first")).join(second.select(*keys, F.col("value").alias("second")), keys, "outer")
    verdict = F.when(F.col("second").isNull(), "FIRST_ONLY").when(F.col("first").isNull(), "SECOND_ONLY").when(relative_gap(F.col("first"), F.col("second")) <= tolerance, "MATCH").otherwise("MISMATCH")
    return both.withColumn("verdict", verdict)


def mismatch_reason(a: Column, b: Column) -> Column:
    """The first band that the ratio falls in: sign, unit of 1000, 100 or 10, rounding, else scope."""
    ratio = F.try_divide(a, b)
    near = lambda r, x, t=0.05: F.abs(r - x) <= x * t
    size = F.abs(ratio)
    return (
        F.when(ratio.isNull(), "UNKNOWN").when(near(-ratio, 1.0), "SIGN").when(near(size, 1000.0) | near(size, 0.001), "UNIT_1000").when(near(size, 100.0) | near(size, 0.01), "UNIT_100")
        .when(near(size, 10.0) | near(size, 0.1), "UNIT_10").when(near(size, 1.0, 0.10), "ROUNDING").otherwise("SCOPE")
    )


def tolerance_for(v: Column) -> Column:
    return F.when(F.abs(v) >= 1000, 0.001).when(F.abs(v) >= 100, 0.005).otherwise(0.01)


def best_row(rows: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """Of each key the row with the highest score, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), seq)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def consensus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, primary (lowest priority number), median, mean, majority (commonest to 4 places, smaller on ties), trusted (highest trust)."""
    votes = rows.groupBy(*keys, F.round("value", 4).alias("v")).agg(F.count("*").alias("c"))
    majority = votes.groupBy(*keys).agg(F.min_by("v", F.struct(-F.col("c"), "v")).alias("majority"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("value", "priority").alias("primary"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"), F.max_by("value", F.struct("trust", -F.col("priority"))).alias("trusted"))
    return stats.join(majority, keys)


def traffic_light(n: Column, passed: Column, least: int = 2) -> Column:
    return F.when(n < least, "RED").when(passed >= n - 1, "GREEN").when(passed > 0, "YELLOW").otherwise("RED")
