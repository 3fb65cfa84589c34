"""Writing tables: fan-out, upserts, append-only ledgers. Every merge is a join, every write is Spark's own."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_csv_with_mark(df: DataFrame, folder: str) -> None:
    """CSV for spreadsheets: each file begins with a byte order mark, which is the first character of its header."""
    first, *rest = df.columns
    df.select(F.col(first).alias("\ufeff" + first), *rest).write.option("header", True).csv(folder)


def fan_out(df: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "csv", "json")) -> list[tuple[str, int | None]]:
    """Write in each format and read back: (format, rows found), or None where a format fails; the others go on."""
    spark, out = df.sparkSession, []
    df.write.mode("overwrite").parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")  # all formats are made from it, not from df again
    for form in formats:
        header = {"header": "true"} if form == "csv" else {}
        try:
            kept.write.mode("overwrite").options(**header).format(form).save(f"{folder}/{form}")
            out.append((form, spark.read.options(**header).format(form).load(f"{folder}/{form}").count()))
        except (PySparkException, Py4JJavaError):
            out.append((form, None))
    return out


def save_by_year(old: DataFrame | None, new: DataFrame, keys: list[str], day: str, folder: str, order: str | None = None) -> None:
    """Rows by key, the new ones winning and of those the last by ``order``, in a folder per year; only years that changed are replaced.

    ``old`` must not be read from ``folder`` itself but from a snapshot of it.
    """
    tagged = new.withColumn("__seq", F.lit(1))
    if old is not None:
        tagged = tagged.unionByName(old.withColumn("__seq", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__seq"), *([F.desc(order)] if order else []))
    latest = tagged.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__seq").withColumn("year", F.year(day))
    changed = new.select(F.year(day).alias("year")).distinct()
    latest.join(changed, "year", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(folder)


def replace_and_extend(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new; columns that one of them lacks are null there."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def flat(df: DataFrame) -> DataFrame:
    """Fields of structs as columns ``a.b``, arrays of simple values joined by commas."""
    out = []
    for f in df.schema:
        inner = [(f"{f.name}.{g.name}", F.col(f.name)[g.name], g.dataType) for g in f.dataType] if f.dataType.typeName() == "struct" else [(f.name, F.col(f"`{f.name}`"), f.dataType)]
        out += [(F.array_join(c, ",") if t.typeName() == "array" else c).alias(name) for name, c, t in inner]
    return df.select(*out)


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """All rows with an ``action``: added, updated, unchanged or stale. Columns in ``kept`` hold what was edited by hand."""
    columns = [c for c in new.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("__old"))
    b = new.select(key, F.struct(*columns).alias("__new"))
    both = a.join(b, key, "outer")
    action = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "stale").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    pick = lambda c: F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in kept else F.when(F.col("__new").isNull(), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}"))
    return both.select(key, *[pick(c).alias(c) for c in columns], action.alias("action"))


def unseen(ledger: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose hash the ledger lacks, each once, with their ``record_hash``."""
    hashed = new.withColumn("record_hash", F.sha2(F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in columns]), 256))
    return hashed.dropDuplicates(["record_hash"]).join(ledger.select("record_hash"), "record_hash", "left_anti").select(*new.columns, "record_hash")


def versions(old: DataFrame, new: DataFrame, key: str, as_of) -> DataFrame:
    """History with valid_from and valid_to (null: active): changed keys end and begin anew, keys that are gone end, unchanged ones stay."""
    columns = [c for c in new.columns if c != key]
    active, past = old.where("valid_to is null"), old.where("valid_to is not null")
    now = F.lit(as_of).cast("date")
    joined = active.select(key, *[F.col(c).alias(f"o_{c}") for c in columns], "valid_from").join(new.withColumn("__new", F.lit(True)), key, "outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(c))
    is_old, is_new = F.col("valid_from").isNotNull(), F.col("__new").isNotNull()
    ended = joined.where(is_old).select(key, *[F.col(f"o_{c}").alias(c) for c in columns], "valid_from", F.when(~is_new | ~same, now).alias("valid_to"))
    begun = joined.where(is_new & (~is_old | ~same)).select(key, *columns, now.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return past.unionByName(ended).unionByName(begun)
