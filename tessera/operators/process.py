"""Process mining over event logs (case, activity, ts, seq): window expressions and joins, ties in time broken by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_case():
    return Window.partitionBy("case").orderBy("ts", "seq")


def steps(log: DataFrame) -> DataFrame:
    """The log with the next activity and the seconds until it."""
    return log.withColumn("next", F.lead("activity").over(in_case())).withColumn("wait", F.unix_micros(F.lead("ts").over(in_case())) / 1e6 - F.unix_micros("ts") / 1e6)


def directly_follows(log: DataFrame) -> DataFrame:
    """source, target, n, mean_wait in seconds."""
    return steps(log).where("next is not null").groupBy(F.col("activity").alias("source"), F.col("next").alias("target")).agg(F.count("*").alias("n"), F.avg("wait").alias("mean_wait"))


def ends(log: DataFrame) -> DataFrame:
    """activity, starts, finishes: how many cases begin and end with it."""
    first, last = F.row_number().over(in_case()) == 1, F.lead("activity").over(in_case()).isNull()
    marked = log.select("activity", first.alias("first"), last.alias("last"))
    return marked.groupBy("activity").agg(F.count_if("first").alias("starts"), F.count_if("last").alias("finishes")).where("starts + finishes > 0")


def durations(log: DataFrame) -> DataFrame:
    """case, events, seconds from first to last event."""
    return log.groupBy("case").agg(F.count("*").alias("events"), (F.unix_micros(F.max("ts")) / 1e6 - F.unix_micros(F.min("ts")) / 1e6).alias("seconds"))


def rework(log: DataFrame) -> DataFrame:
    """activity, self_loops, revisits (cases that come back to it)."""
    x = log.withColumn("again", (F.lag("activity").over(in_case()) == F.col("activity")).cast("int"))
    per_case = x.groupBy("case", "activity").agg(F.sum(F.coalesce("again", F.lit(0))).alias("loops"), F.count("*").alias("n"))
    return per_case.groupBy("activity").agg(F.sum("loops").alias("self_loops"), F.count_if(F.col("n") > 1).alias("revisits"))


def conformance(log: DataFrame, expected: list[str]) -> DataFrame:
    """case, backward, skips against an expected order of activities; others are not judged."""
    place = F.array_position(F.array(*map(F.lit, expected)), F.col("activity"))
    x = log.select("case", "ts", "seq", place.alias("place")).where("place > 0").withColumn("jump", F.lead("place").over(in_case()) - F.col("place"))
    return x.groupBy("case").agg(F.count_if(F.col("jump") < 0).alias("backward"), F.count_if(F.col("jump") > 1).alias("skips"))


def variants(log: DataFrame) -> DataFrame:
    """variant (activities in order), n, cases of a case's bounded trace."""
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "activity"))), lambda e: e["activity"]), ">")
    return log.groupBy("case").agg(trace.alias("variant")).groupBy("variant").agg(F.count("*").alias("n"), F.min("case").alias("first_case"))


def without_adjacent_repeats(log: DataFrame) -> DataFrame:
    return log.withColumn("before", F.lag("activity").over(in_case())).where("before is null or before <> activity").drop("before")


def co_occurrence(log: DataFrame) -> DataFrame:
    """a, b, cases: activities of one case; distinct activities per case first, so a case gives few pairs."""
    one = log.select("case", "activity").distinct()
    other = one.select("case", F.col("activity").alias("b"))
    return one.withColumnRenamed("activity", "a").join(other, "case").where("a < b").groupBy("a", "b").agg(F.count("*").alias("cases"))
