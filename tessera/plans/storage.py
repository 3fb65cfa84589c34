"""Sources and sinks: each query writes a table in some form to the shared folder, reads it back and gives its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.sources import readers, sinks
from tessera.sources.shared import work_folder

_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_SCHEMA = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def _supplier(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(_SUPPLIER)
def csv_for_spreadsheets(t: Tables) -> DataFrame:
    """SRC-03 and SNK-02: CSV with a byte order mark before each header, read back under the plain names."""
    folder = work_folder(t.spark, "csv")
    sinks.write_csv_with_mark(_supplier(t), folder)
    return readers.read(t.spark, folder, "csv", _SCHEMA)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def json_first_list(t: Tables) -> DataFrame:
    """SRC-04: JSON documents whose first list of records holds the rows."""
    folder = work_folder(t.spark, "json")
    docs = t.orders.groupBy(F.col("o_custkey").alias("about")).agg(F.collect_list(F.struct("o_custkey", "o_orderkey", "o_totalprice")).alias("rows"))
    docs.write.json(folder)
    return readers.json_rows(t.spark.read.json(folder))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3")
def event_lines(t: Tables) -> DataFrame:
    """SRC-11: a log of JSON lines; malformed ones are passed over."""
    folder = work_folder(t.spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(folder)
    return readers.read(t.spark, folder, "jsonl", "event_id long, event_type string")


@query("SELECT s_suppkey, 'Société ' || s_name AS s_name FROM supplier")
def encoded_csv(t: Tables) -> DataFrame:
    """SRC-07 and SRC-08: a CSV in another encoding than UTF-8, which is found by trying."""
    folder = work_folder(t.spark, "latin")
    _supplier(t).select("s_suppkey", F.concat(F.lit("Société "), "s_name").alias("s_name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(folder)
    found, encoding = readers.with_encoding(t.spark, folder, ("UTF-8", "ISO-8859-1"))
    assert encoding == "ISO-8859-1"
    return found.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query(_SUPPLIER)
def source_chain(t: Tables) -> DataFrame:
    """SRC-01: of a missing Parquet file, an empty CSV and JSON records, the first that has rows serves."""
    folder = work_folder(t.spark, "chain")
    _supplier(t).limit(0).write.option("header", True).csv(f"{folder}/csv")
    _supplier(t).write.json(f"{folder}/json")
    found, why = readers.first_source(t.spark, [(f"{folder}/none", "parquet"), (f"{folder}/csv", "csv"), (f"{folder}/json", "jsonl")], _SCHEMA)
    assert len(why) == 2
    return found


@query("SELECT o_orderkey AS ticker, o_totalprice AS close, CAST(o_orderdate AS DATE) AS date, CAST(NULL AS VARCHAR) AS volume FROM orders")
def header_synonyms(t: Tables) -> DataFrame:
    """SRC-12, SRC-17, PRJ-05 and PRJ-11: headers in other languages become the declared columns; missing ones are null."""
    foreign = t.orders.select(F.col("o_totalprice").alias("收盤"), F.col("o_orderkey").alias("代號"), F.to_date("o_orderdate").alias("日期"), F.lit(1).alias("extra"))
    return readers.canonical(foreign, ["ticker", "close", "date", "volume"])


@query("SELECT * FROM (VALUES ('dict', 'a', 'x'), ('dict', 'a', 'y'), ('dict', 'b', 'z'), ('records', 'a', 'x'), ('records', 'b', 'z'), ('lists', 'a', 'x'), ('lists', 'a', 'y'), ('flat', 'GROUP', 'x'), ('flat', 'GROUP', 'z')) AS v(shape, grp, member)")
def theme_shapes(t: Tables) -> DataFrame:
    """SRC-09: a small dictionary of groups in each of its four shapes."""
    shapes = {"dict": {"a": ["x", "y"], "b": ["z"]}, "records": [{"name": "a", "members": ["x"]}, {"name": "b", "members": ["z"]}], "lists": [["a", "x", "y"]], "flat": ["x", "z"]}
    out = [readers.group_members(t.spark, v).select(F.lit(k).alias("shape"), "grp", "member") for k, v in shapes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT form, (SELECT count(*) FROM orders) AS n_rows, 'ok' AS state FROM (VALUES ('parquet'), ('csv'), ('json'), ('orc')) AS v(form) UNION ALL SELECT 'nosuch', NULL, 'failed'")
def fan_out_counts(t: Tables) -> DataFrame:
    """SNK-01, SNK-04 and SNK-15: one table in several formats, each read back and counted; a format that fails is recorded and the others go on."""
    found = sinks.fan_out(t.orders.select("o_orderkey", "o_totalprice"), work_folder(t.spark, "fan"), ("parquet", "csv", "json", "orc", "nosuch"))
    return t.spark.createDataFrame([(f, n, "ok" if n is not None else "failed") for f, n in found], "form string, n_rows long, state string")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def year_folders(t: Tables) -> DataFrame:
    """SNK-05: rows by key in a folder per year, later rows winning; years without news are not written again."""
    folder = work_folder(t.spark, "years")
    day, price = F.to_date("o_orderdate").alias("d"), F.col("o_totalprice")
    first = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", day, price.alias("price"), F.lit(0).alias("seq"))
    sinks.save_by_year(None, first, ["o_orderkey"], "d", f"{folder}/store", "seq")
    t.spark.read.parquet(f"{folder}/store").drop("year").write.parquet(f"{folder}/snapshot")
    news = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", day, F.explode(F.array(F.struct(price.alias("price"), F.lit(1).alias("seq")), F.struct((price * 2).alias("price"), F.lit(2).alias("seq")))).alias("x")).select("o_orderkey", "d", "x.price", "x.seq")
    sinks.save_by_year(t.spark.read.parquet(f"{folder}/snapshot"), news, ["o_orderkey"], "d", f"{folder}/store", "seq")
    return t.spark.read.parquet(f"{folder}/store").select("o_orderkey", "d", "price")


@query("SELECT s_suppkey AS doc_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey END AS nation FROM supplier")
def schema_evolution(t: Tables) -> DataFrame:
    """SNK-08: rows of known ids are replaced, and a column that is new is added for all."""
    old = t.supplier.where("s_suppkey % 4 <> 0 or s_suppkey % 8 = 0").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 8 == 0, "outdated").otherwise(F.col("s_name")).alias("name"))
    new = t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return sinks.replace_and_extend(old, new, "doc_id")


@query("SELECT p_partkey AS doc_id, p_type AS \"aspects.domain\", p_partkey || ',' || p_size AS \"aspects.pii\", p_size AS \"intel.sentences\", '' AS \"mail.subject\" FROM part")
def flat_records(t: Tables) -> DataFrame:
    """SNK-10: nested records become flat columns for tabular sinks; lists are joined by commas, missing text is empty."""
    k, s = F.col("p_partkey"), F.col("p_size")
    nested = t.part.select(
        k.alias("doc_id"), F.struct(F.col("p_type").alias("domain"), F.array(k.cast("string"), s.cast("string")).alias("pii")).alias("aspects"),
        F.struct(s.alias("sentences")).alias("intel"), F.struct(F.lit(None).cast("string").alias("subject")).alias("mail"),
    )
    return sinks.flat(nested).withColumn("mail.subject", F.coalesce(F.col("`mail.subject`"), F.lit("")))


@query("SELECT o_custkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR AS snapshot, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def derived_snapshot(t: Tables) -> DataFrame:
    """SNK-11: raw rows are kept whole; of what is derived only the last row is, as JSON with the number of rows."""
    folder = work_folder(t.spark, "raw")
    t.orders.write.parquet(folder)
    last = F.max(F.struct("o_orderkey", "o_orderstatus"))
    return t.spark.read.parquet(folder).groupBy("o_custkey").agg(F.to_json(last).alias("snapshot"), F.count("*").alias("n"))


@query("SELECT user_id AS \"case\", event_type AS activity, CAST(ts AS TIMESTAMP) AS at FROM events")
def event_log_csv(t: Tables) -> DataFrame:
    """SNK-13: an event log as CSV."""
    folder = work_folder(t.spark, "log")
    t.events.select(F.col("user_id").alias("case"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("at")).write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(folder)
    return t.spark.read.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").schema("`case` long, activity string, at timestamp").csv(folder)


@query("SELECT * FROM (VALUES ('datasets', 'rates', 'US10Y', 'a|b'), ('datasets', 'rates', 'US2Y', ''), ('datasets', 'fx', 'TWD', 'c'), ('engine_inputs', 'risk', 'VIX', 'a')) AS v(section, grp, id, panels)")
def manifest_rows(t: Tables) -> DataFrame:
    """SRC-18: a nested manifest, section by section and group by group, as rows."""
    manifest = '{"datasets": {"rates": [{"id": "US10Y", "panels": ["a", "b"]}, {"id": "US2Y"}], "fx": [{"id": "TWD", "panels": ["c"]}]}, "engine_inputs": {"risk": [{"id": "VIX", "panels": ["a"]}]}, "note": {}}'
    return readers.manifest_rows(t.spark.createDataFrame([(manifest,)], "manifest string"), "manifest")


@query("SELECT s_suppkey, unnest(['2023A', '2024A', '2025E']) AS period, unnest([s_acctbal, s_acctbal * 1.5, s_acctbal * 2]) AS value FROM supplier")
def period_maps(t: Tables) -> DataFrame:
    """AR-02: a map of period to value in each row, written, read and taken apart."""
    folder, v = work_folder(t.spark, "maps"), F.col("s_acctbal")
    t.supplier.select("s_suppkey", F.create_map(F.lit("2023A"), v, F.lit("2024A"), v * 1.5, F.lit("2025E"), v * 2).alias("by_period")).write.parquet(folder)
    return t.spark.read.parquet(folder).select("s_suppkey", F.explode("by_period").alias("period", "value"))


@query("""WITH u AS (SELECT s_suppkey AS code, CASE s_nationkey % 3 WHEN 0 THEN 'TWSE' WHEN 1 THEN 'TPEX' ELSE 'ETF' END AS market FROM supplier UNION SELECT 999999, 'TWSE')
    SELECT code, market, code || CASE market WHEN 'TWSE' THEN '.TW' ELSE '.TWO' END AS yf FROM u WHERE market IN ('TWSE', 'TPEX') ORDER BY code LIMIT 40""")
def universe(t: Tables) -> DataFrame:
    """SRC-15: listed codes of some markets with their tickers, extras added, the first forty."""
    m = F.col("s_nationkey") % 3
    listed = t.supplier.select(F.col("s_suppkey").alias("code"), F.when(m == 0, "TWSE").when(m == 1, "TPEX").otherwise("ETF").alias("market"))
    extra = t.spark.createDataFrame([(999999, "TWSE")], "code long, market string")
    both = listed.unionByName(extra).distinct().where(F.col("market").isin("TWSE", "TPEX"))
    return both.withColumn("yf", F.concat(F.col("code").cast("string"), F.when(F.col("market") == "TWSE", ".TW").otherwise(".TWO"))).orderBy("code").limit(40)


@query("""WITH f AS (SELECT p_brand AS file, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part WHERE p_partkey % 6 <> 0),
    g AS (SELECT file, avg(CASE WHEN p_size >= 15 THEN 1.0 ELSE 0.0 END) AS valid FROM f WHERE i <= 10 GROUP BY 1)
    SELECT file, round(valid, 4) AS valid, valid >= 0.7 AS passed FROM g""")
def row_gate(t: Tables) -> DataFrame:
    """PRJ-13: of the first ten rows of a file that are not blank, 70 % must be valid, or the file is held back whole."""
    rows = t.part.where("p_partkey % 6 <> 0").select(F.col("p_brand").alias("file"), "p_partkey", (F.col("p_size") >= 15).alias("ok"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("p_partkey"))).where("i <= 10")
    g = first.groupBy("file").agg(F.avg(F.col("ok").cast("double")).alias("valid"))
    return g.select("file", F.round("valid", 4).alias("valid"), (F.col("valid") >= 0.7).alias("passed"))
