"""Reading tables from several formats, with fallbacks, and shaping them to a declared schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Header words, in any language, and the column they mean.
SYNONYMS = {
    "date": ["date", "day", "trade_date", "日期", "datum"], "open": ["open", "開盤", "o"], "high": ["high", "最高", "h"], "low": ["low", "最低", "l"],
    "close": ["close", "收盤", "price", "c"], "volume": ["volume", "vol", "成交量"], "ticker": ["ticker", "symbol", "code", "代號"],
}


def read(spark: SparkSession, path: str, form: str, schema: StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One table of the given format: parquet, orc, csv (with header), json (records) or jsonl (malformed lines dropped)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if form == "csv":
        return reader.option("header", True).option("encoding", encoding).csv(path)
    if form == "json":
        return reader.option("multiLine", True).option("encoding", encoding).json(path)
    if form == "jsonl":
        return reader.option("mode", "DROPMALFORMED").json(path)
    return reader.format(form).load(path)


def json_rows(docs: DataFrame) -> DataFrame:
    """The records of JSON documents: those of the first list of records among the columns, or the documents themselves."""
    lists = [f.name for f in docs.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    return docs.select(F.inline(lists[0])) if lists else docs


def manifest_rows(docs: DataFrame, column: str) -> DataFrame:
    """section, grp, id, panels (joined by bars) of manifests {section: {group: [{id, panels}]}}; groups of another shape are passed over."""
    sections = F.from_json(column, "map<string, map<string, array<struct<id: string, panels: array<string>>>>>")
    groups = docs.select(F.explode(sections).alias("section", "groups")).select("section", F.explode("groups").alias("grp", "items"))
    return groups.select("section", "grp", F.inline("items")).select("section", "grp", "id", F.coalesce(F.array_join("panels", "|"), F.lit("")).alias("panels"))


def first_source(spark: SparkSession, candidates: list[tuple[str, str]], schema: StructType | str | None = None) -> tuple[DataFrame | None, list[str]]:
    """The first of (path, format) that can be read and has rows, and why those before it could not serve."""
    why = []
    for path, form in candidates:
        try:
            df = read(spark, path, form, schema)
            if not df.isEmpty():
                return df, why
            why.append(f"{form}: empty")
        except AnalysisException as e:
            why.append(f"{form}: {type(e).__name__}")
    return None, why


def with_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "Big5", "GBK", "ISO-8859-1")) -> tuple[DataFrame, str]:
    """A CSV in the first encoding under which its lines hold no replacement characters."""
    for e in encodings[:-1]:
        lines = spark.read.schema("value string").option("encoding", e).option("sep", "\u0001").option("quote", "").csv(path)
        if lines.where(F.contains("value", F.lit("�"))).isEmpty():
            return read(spark, path, "csv", encoding=e), e
    return read(spark, path, "csv", encoding=encodings[-1]), encodings[-1]


def table(spark: SparkSession, locator: str) -> DataFrame:
    """A table name or a SELECT over registered views."""
    return spark.sql(locator) if locator.lstrip()[:6].upper() == "SELECT" else spark.table(locator)


def canonical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns renamed by header synonyms (the first that fits wins); with ``columns``, those only, missing ones null."""
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {}
    for name, words in SYNONYMS.items():
        for w in words:
            if w in by_name:
                found[by_name[w]] = name
                break
    out = df.withColumnsRenamed(found)
    if columns is None:
        return out
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns])


def group_members(spark: SparkSession, themes) -> DataFrame:
    """grp, member of a small dictionary of groups, given as {name: members}, [{name, members}], [[name, member...]] or [member...]."""
    if isinstance(themes, dict):
        pairs = [(k, m) for k, ms in themes.items() for m in ms]
    elif themes and isinstance(themes[0], dict):
        pairs = [(g["name"], m) for g in themes for m in g["members"]]
    elif themes and isinstance(themes[0], (list, tuple)):
        pairs = [(g[0], m) for g in themes for m in g[1:]]
    else:
        pairs = [("GROUP", m) for m in themes]
    return spark.createDataFrame(pairs, "grp string, member string")
