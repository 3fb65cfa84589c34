"""Places, ranks and exact quantiles within groups of any size.

A window by group sorts a whole group in one task. Here rows are range-partitioned by group and value, numbered within each
partition, and moved on by the counts of the partitions before; so a group that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import work_folder


def positions(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with ``place`` (from 0) of each row within its group and ``size`` of the group. ``order`` should end with a column that tells equal rows apart, so that a hot value can be split."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, "ranges")
    df.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))  # as many rows as partitions and groups
    w = Window.partitionBy(group)
    before = F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("size"))
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    out = dealt.withColumn("__own", own).join(counts, (F.col("__g").eqNullSafe(F.col(group))) & (F.col("__p") == F.col("__part")))
    return out.select(*df.columns, (F.col("__own") + F.col("__before")).alias("place"), "size")


def competition_rank(df: DataFrame, value: str, unique: str, name: str) -> DataFrame:
    """df with the rank of ``value`` over all rows, from 1 for the smallest; equal values share the smallest place. No task sorts more than its range."""
    at = positions(df.withColumn("__all", F.lit(0)), "__all", value, unique)
    first = at.groupBy(F.col(value).alias("__v")).agg((F.min("place") + 1).alias(name))
    return at.join(first, F.col(value).eqNullSafe(F.col("__v"))).select(*df.columns, name)


def fill_down(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """df with the nulls of ``columns`` replaced by the last value above them in their group.

    Each range of rows is filled by itself and then from the last values of the ranges before it, so a group may hold any share of the rows.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, "fills")
    df.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns]
    ends = dealt.groupBy(group, "__part").agg(*last)  # as many rows as partitions and groups
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), *[F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    above = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({c: F.last(c, ignorenulls=True).over(above) for c in columns})
    out = own.join(ends, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__p") == F.col("__part")))
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else c for c in df.columns])


def average_rank(df: DataFrame, group: str, value: str, unique: str, name: str) -> DataFrame:
    """``unique`` and the rank of ``value`` in its group (from 1, equal values sharing their mean rank)."""
    at = positions(df.select(group, value, unique), group, value, unique)
    tie = at.groupBy(group, value).agg((F.min("place") + (F.count("*") - 1) / 2.0 + 1).alias(name))
    return at.join(tie, [group, value]).select(unique, name)


def quantiles(df: DataFrame, group: str, value: str, unique: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with an interpolated quantile for each name in ``shares``; null values do not count."""
    at = positions(df.select(group, value, unique).where(F.col(value).isNotNull()), group, value, unique)
    out = []
    for name, share in shares.items():
        exact = (F.col("size") - 1) * F.lit(float(share))
        low = F.floor(exact)
        a, b = F.max(F.when(F.col("place") == low, F.col(value))), F.max(F.when(F.col("place") == F.ceil(exact), F.col(value)))
        out.append((a + (b - a) * F.max(exact - low)).alias(name))
    return at.groupBy(group).agg(*out)
