"""Streams over the event files, run once over all that is there, and merges into ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.sources import sinks
from tessera.streaming import events as ev


def _stream(t: Tables) -> DataFrame:
    return ev.stream(t.spark, f"{t.folder}/events.parquet")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_windows(t: Tables) -> DataFrame:
    """STR-01: the complete state after the last batch."""
    out = ev.run_once(ev.tumbling(_stream(t)), "complete")
    return out.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT time_bucket(INTERVAL 3 HOUR, ts) - CAST(k AS INT) * INTERVAL 3 HOUR AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def stream_sliding_windows(t: Tables) -> DataFrame:
    """STR-01: six hours wide, every three hours."""
    return ev.run_once(ev.sliding(_stream(t)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH x AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), y AS (SELECT user_id, ts, sum(CAST(gap IS NULL OR gap > INTERVAL 6 HOUR AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
    SELECT user_id, count(*) AS n, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM y GROUP BY user_id, s""")  # fmt: skip
def session_windows(t: Tables) -> DataFrame:
    """STR-01: sessions end after six hours of silence."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = ev.sessions(e)
    return s.select("user_id", "n", F.round(F.unix_micros("end") / 1e6 - F.unix_micros("start") / 1e6 - 21600, 3).alias("seconds"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_first_sights(t: Tables) -> DataFrame:
    """STR-02 and STR-03: each event once, although the stream brings every one twice."""
    s = _stream(t)
    return ev.run_once(ev.first_sights(s.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")).select("event_id", "user_id", "event_type"))


@query("SELECT json_extract_string(props, '$.k') AS code, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 3")
def evolving_registry(t: Tables) -> DataFrame:
    """STR-05: codes seen at least three times."""
    s = _stream(t).groupBy(F.get_json_object("props", "$.k").alias("code")).agg(F.count("*").alias("n"))
    return ev.run_once(s, "complete").where("n >= 3")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'added' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'unchanged' END ELSE 'stale' END AS action, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance,
    c_mktsegment AS status FROM customer""")  # fmt: skip
def ledger_upsert(t: Tables) -> DataFrame:
    """SNK-06, SNK-07 and STR-04: merged by key, the status edited by hand stays."""
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("status"))
    old = c.where("k % 3 <> 0")
    new = c.where("k % 3 <> 2").withColumn("balance", F.when((F.col("k") % 2 == 0) & (F.col("k") % 3 == 1), F.col("balance") + 1).otherwise(F.col("balance")))
    return sinks.upsert(old, new, "k", kept=("status",))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey % 4 = 0")
def ledger_unseen(t: Tables) -> DataFrame:
    """SNK-08 and SNK-09: only records whose hash is new are appended."""
    c = t.customer.select("c_custkey", "c_name")
    ledger = sinks.unseen(t.spark.createDataFrame([], "record_hash string"), c.where("c_custkey % 4 <> 0"), ["c_custkey", "c_name"])
    return sinks.unseen(ledger, c.unionByName(c), ["c_custkey", "c_name"]).agg(F.count("*").alias("n"))


@query("""SELECT k, v, valid_from, valid_to FROM (SELECT c_custkey AS k, c_acctbal AS v, DATE '2024-01-01' AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-02-01' END AS valid_to FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END, DATE '2024-02-01', NULL FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0)""")  # fmt: skip
def versioned_sync(t: Tables) -> DataFrame:
    """REC-07 and PRJ-14: changed keys get a new version, the old one an end."""
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    old = c.where("k % 5 <> 0").withColumn("valid_from", F.lit("2024-01-01").cast("date")).withColumn("valid_to", F.lit(None).cast("date"))
    return sinks.versions(old, c.withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v") + 1).otherwise(F.col("v"))), "k", "2024-02-01")
