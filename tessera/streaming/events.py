"""Event streams: windows with watermarks, sessions, first sights, counts with a threshold.

Each function takes a batch or a streaming DataFrame of (event_id, ts timestamp, user_id, event_type, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import work_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files of a folder, or one such file, as a stream; timestamps as instants."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_sights(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often its id comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_once(results: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote: files for appends, the last state otherwise."""
    spark = results.sparkSession
    folder = work_folder(spark, "stream")
    writer = results.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        query = writer.outputMode("complete").foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{folder}/out")
