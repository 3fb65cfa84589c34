"""Tables in the folder that all executors share; they cut lineage and survive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run in this process, as in tests. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of rows that pass to Python hold at most 4 MB, unless the session sets another bound: texts may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


class Scratch:
    """Hands out tables under the shared folder and drops them again.

    ``table`` writes a DataFrame as Parquet and rereads it, so what follows neither recomputes it nor
    depends on one executor. Drop a table only when nothing lazy reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", [], 0
        bounded_batches(spark)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{name}-{self.count}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self.made.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Drop the tables of these names, or all of them."""
        self._delete([p for p in self.made if not names or p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names])

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
            self.made.remove(path)
