"""Relational queries: projections, joins, aggregates, sorts, set operations and cross-validation on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import reconcile, ranks
from tessera.plans.registry import Tables, query


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 100000 AND 200000")
def membership_and_range(t: Tables) -> DataFrame:
    """PRJ-01"""
    return t.orders.where(F.col("o_orderstatus").isin("F", "P") & F.col("o_totalprice").between(100000, 200000)).select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AND lower(trim(event_type)) NOT IN ('', 'none', 'nan', 'nat')""")
def typed_cleaning(t: Tables) -> DataFrame:
    """PRJ-04, PRJ-06, FN-01 and JS-01: numbers from JSON, blank keys left out."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t.events.where(k.isNotNull() & ~F.lower(F.trim("event_type")).isin("", "none", "nan", "nat")).select("event_id", k.alias("k"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') THEN 'cold' WHEN contains(p_name, 'ring') THEN 'jewel' ELSE 'other' END AS bucket FROM part")
def keyword_buckets(t: Tables) -> DataFrame:
    """PRJ-07: the first bucket in order whose word is in the text."""
    bucket = F.lit("other")
    for word, name in reversed([("red", "warm"), ("blue", "cold"), ("ring", "jewel")]):
        bucket = F.when(F.contains("p_name", F.lit(word)), name).otherwise(bucket)
    return t.part.select("p_partkey", bucket.alias("bucket"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 5000 THEN 'A' WHEN c_acctbal > 5000 THEN 'B' WHEN c_nationkey < 5 THEN 'C' ELSE 'D' END AS flag, 'synthetic' AS source FROM customer")
def quality_cascade(t: Tables) -> DataFrame:
    """PRJ-09 and PRJ-10: ordered rules and a constant column."""
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(b < 0, "NEGATIVE").when((F.col("c_mktsegment") == "MACHINERY") & (b > 5000), "A").when(b > 5000, "B").when(F.col("c_nationkey") < 5, "C").otherwise("D").alias("flag"), F.lit("synthetic").alias("source"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_in(t: Tables) -> DataFrame:
    """PRJ-12"""
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_chain(t: Tables) -> DataFrame:
    """JN-01, JN-02 and JN-07: left joins to small dimensions, which Spark broadcasts by their size."""
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers, coalesce(suppliers, 0) AS filled FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def outer_enrichment(t: Tables) -> DataFrame:
    """JN-03, JN-04 and SO-05"""
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "outer").select("nation", "customers", "suppliers", F.coalesce("suppliers", F.lit(0)).alias("filled"))


_FACTS = """a AS (SELECT o_custkey AS cust, year(o_orderdate) AS yr, sum(o_totalprice) AS value FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1, 2),
    b AS (SELECT o_custkey AS cust, year(o_orderdate) AS yr, sum(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 1000 WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END) AS value FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1, 2)"""


def _facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    keys = [F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("yr")]
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    first = t.orders.where(k % 11 != 0).groupBy(*keys).agg(F.sum(price).alias("value"))
    return first, t.orders.where(k % 13 != 0).groupBy(*keys).agg(F.sum(F.when(k % 7 == 0, price * 1000).when(k % 5 == 0, -price).otherwise(price)).alias("value"))


_GAP = "coalesce(abs(a.value - b.value) / nullif(greatest(abs(a.value), abs(b.value)), 0), 0)"


@query(f"""WITH {_FACTS} SELECT coalesce(a.cust, b.cust) AS cust, CAST(coalesce(a.yr, b.yr) AS INT) AS yr, CASE WHEN b.value IS NULL THEN 'FIRST_ONLY' WHEN a.value IS NULL THEN 'SECOND_ONLY' WHEN {_GAP} <= 0.02 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict
    FROM a FULL JOIN b ON a.cust = b.cust AND a.yr = b.yr""")  # fmt: skip
def phase_compare(t: Tables) -> DataFrame:
    """JN-06 and FN-07"""
    return reconcile.compare(*_facts(t), ["cust", "yr"]).select("cust", "yr", "verdict")


@query(f"""WITH {_FACTS}, r AS (SELECT a.cust, CAST(a.yr AS INT) AS yr, a.value / nullif(b.value, 0) AS q, abs(a.value / nullif(b.value, 0)) AS s FROM a JOIN b ON a.cust = b.cust AND a.yr = b.yr WHERE {_GAP} > 0.02)
    SELECT cust, yr, CASE WHEN q IS NULL THEN 'UNKNOWN' WHEN abs(-q - 1) <= 0.05 THEN 'SIGN' WHEN abs(s - 1000) <= 50 OR abs(s - 0.001) <= 0.00005 THEN 'UNIT_1000' WHEN abs(s - 100) <= 5 OR abs(s - 0.01) <= 0.0005 THEN 'UNIT_100'
    WHEN abs(s - 10) <= 0.5 OR abs(s - 0.1) <= 0.005 THEN 'UNIT_10' WHEN abs(s - 1) <= 0.1 THEN 'ROUNDING' ELSE 'SCOPE' END AS reason FROM r""")  # fmt: skip
def mismatch_reasons(t: Tables) -> DataFrame:
    """FN-08"""
    both = reconcile.compare(*_facts(t), ["cust", "yr"]).where("verdict = 'MISMATCH'")
    return both.select("cust", "yr", reconcile.mismatch_reason(F.col("first"), F.col("second")).alias("reason"))


@query("SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_orderkey = (SELECT max(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def latest_per_key(t: Tables) -> DataFrame:
    """JN-09"""
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer")
def correlated_count(t: Tables) -> DataFrame:
    """JN-10"""
    n = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"))


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON starts_with(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), lpad(CAST(s_suppkey AS VARCHAR), 7, '0'))")
def prefix_join(t: Tables) -> DataFrame:
    """JN-12: prefixes of one length, of numbers written with leading zeros, join by equality."""
    s = t.supplier.select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 7, "0").alias("prefix"))
    return t.part.select("p_partkey", F.substring(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), 1, 7).alias("prefix")).join(s, "prefix").select("p_partkey", "s_suppkey")


def _prefix_pairs(t: Tables) -> DataFrame:
    """p_partkey, s_suppkey of every supplier whose key begins the part's: one row of a part per length of prefix, joined by equality."""
    prefix = t.supplier.select("s_suppkey", F.col("s_suppkey").cast("string").alias("prefix"))
    lengths = prefix.select(F.length("prefix").alias("n")).distinct()
    full = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("full")).join(F.broadcast(lengths), F.col("n") <= F.length("full"))
    return full.select("p_partkey", F.expr("substring(full, 1, n)").alias("prefix")).join(prefix, "prefix").select("p_partkey", "s_suppkey")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON starts_with(CAST(p_partkey AS VARCHAR), CAST(s_suppkey AS VARCHAR))")
def prefix_join_whole(t: Tables) -> DataFrame:
    """JN-12 over all suppliers, with prefixes of every length"""
    return _prefix_pairs(t)


@query("SELECT s_suppkey, min(CAST(p_partkey AS VARCHAR)) AS first_match FROM part JOIN supplier ON starts_with(CAST(p_partkey AS VARCHAR), CAST(s_suppkey AS VARCHAR)) GROUP BY 1")
def prefix_first_match(t: Tables) -> DataFrame:
    """JN-12: the first match of every prefix, in the order of strings"""
    return _prefix_pairs(t).groupBy("s_suppkey").agg(F.min(F.col("p_partkey").cast("string")).alias("first_match"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 90 AS b FROM orders), n AS (SELECT *, lead(a) OVER w AS na, lead(o_orderkey) OVER w AS nk FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY a, o_orderkey))
    SELECT o_custkey, o_orderkey, nk AS next_key FROM n WHERE na < b""")  # fmt: skip
def overlapping_intervals(t: Tables) -> DataFrame:
    """JN-18 and JN-19: neighbours of one resource that overlap."""
    w = Window.partitionBy("o_custkey").orderBy("a", "o_orderkey")
    i = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a"))
    return i.withColumn("na", F.lead("a").over(w)).withColumn("next_key", F.lead("o_orderkey").over(w)).where(F.col("na") < F.date_add("a", 90)).select("o_custkey", "o_orderkey", "next_key")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(abs(a.v - b.v), 2) AS gap FROM (SELECT n_nationkey, avg(c_acctbal) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) a JOIN (SELECT n_nationkey, avg(c_acctbal) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) b ON a.n_nationkey < b.n_nationkey")
def all_pairs(t: Tables) -> DataFrame:
    """JN-20: pairs of the 25 nations, a fixed dimension."""
    v = t.customer.groupBy(F.col("c_nationkey").alias("a")).agg(F.avg("c_acctbal").alias("v")).join(t.nation.select(F.col("n_nationkey").alias("a")), "a", "left_semi")
    w = v.select(F.col("a").alias("b"), F.col("v").alias("w"))
    return v.join(w, F.col("a") < F.col("b")).select("a", "b", F.round(F.abs(F.col("v") - F.col("w")), 2).alias("gap"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS yr, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS p FROM orders GROUP BY 1")
def sum_pivot(t: Tables) -> DataFrame:
    """AG-01"""
    got = t.orders.groupBy(F.year("o_orderdate").alias("yr")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")).na.fill(0.0)
    return got.select("yr", *[F.round(c, 2).alias(c.lower()) for c in "FOP"])


@query("SELECT CAST(year(ts) AS INT) AS yr, CAST(month(ts) AS INT) AS mo, count(CASE WHEN value > 1 THEN value END) AS n, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def yearly_rollup(t: Tables) -> DataFrame:
    """AG-02 and AG-04: counts of non-null values, not rows."""
    return t.events.groupBy(F.year("ts").alias("yr"), F.month("ts").alias("mo")).agg(F.count(F.when(F.col("value") > 1, F.col("value"))).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS last_view, arg_min(value, event_id) FILTER (event_type = 'click') AS first_click, max(CAST(event_type = 'error' AS INT)) AS had_error FROM events GROUP BY 1")
def last_and_first(t: Tables) -> DataFrame:
    """AG-03 and AG-05"""
    kind = lambda k: F.when(F.col("event_type") == k, F.col("event_id"))
    return t.events.groupBy("user_id").agg(F.max_by("value", kind("view")).alias("last_view"), F.min_by("value", kind("click")).alias("first_click"), F.max((F.col("event_type") == "error").cast("int")).alias("had_error"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def best_row(t: Tables) -> DataFrame:
    """AG-06"""
    return reconcile.best_row(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", "event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    """AG-09: the groups; ``duplicate_quarantine`` splits them."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_nationkey AS nation, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(quantile_cont(c_acctbal, 0.25), 4) AS p25, round(quantile_cont(c_acctbal, 0.75), 4) AS p75, arg_max(c_acctbal, c_custkey) AS present FROM customer GROUP BY 1")
def band_statistics(t: Tables) -> DataFrame:
    """AG-13"""
    b, nation = F.col("c_acctbal"), F.col("c_nationkey").alias("nation")
    q = ranks.quantiles(t.customer.select(nation, "c_acctbal", "c_custkey"), "nation", "c_acctbal", "c_custkey", {"p25": 0.25, "p75": 0.75})
    rest = t.customer.groupBy(nation).agg(F.round(F.min(b), 2).alias("lo"), F.round(F.max(b), 2).alias("hi"), F.round(F.avg(b), 4).alias("mean"), F.round(F.stddev_samp(b), 4).alias("sd"), F.max_by(b, "c_custkey").alias("present"))
    return rest.join(q, "nation").select("nation", "lo", "hi", "mean", "sd", F.round("p25", 4).alias("p25"), F.round("p75", 4).alias("p75"), "present")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS beta, round(regr_intercept(l_extendedprice, l_quantity), 3) AS alpha, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1")
def regression(t: Tables) -> DataFrame:
    """AG-16 and AG-18 for one pair; ``correlation_matrix`` and ``factor_alpha`` do the rest."""
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 5).alias("beta"), F.round(F.regr_intercept(y, x), 3).alias("alpha"), F.round(F.corr(y, x), 6).alias("r"))


@query("""WITH r AS (SELECT event_type, value, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER v + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value), v AS (PARTITION BY event_type ORDER BY user_id)) SELECT event_type, round(corr(a, b), 6) AS ic FROM r GROUP BY 1""")  # fmt: skip
def rank_correlation(t: Tables) -> DataFrame:
    """AG-23: over all rows of a type; types may be few, so ranks come from range partitions."""
    a = ranks.average_rank(t.events, "event_type", "value", "event_id", "a")
    b = ranks.average_rank(t.events, "event_type", "user_id", "event_id", "b")
    return t.events.select("event_type", "event_id").join(a, "event_id").join(b, "event_id").groupBy("event_type").agg(F.round(F.corr("a", "b"), 6).alias("ic"))


@query("SELECT event_type, l[len(l) // 2 + 1] AS p50, l[CAST(floor(len(l) * 0.9) AS BIGINT) + 1] AS p90, l[len(l) // 4 + 1] AS p25 FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events GROUP BY 1)")
def index_percentiles(t: Tables) -> DataFrame:
    """AG-26: percentiles by place, without interpolation."""
    x = ranks.positions(t.events.select("event_type", "value", "event_id"), "event_type", "value", "event_id")
    at = lambda e: F.max(F.when(F.col("place") == F.expr(e), F.col("value")))
    return x.groupBy("event_type").agg(at("size div 2").alias("p50"), at("cast(floor(size * 0.9D) as bigint)").alias("p90"), at("size div 4").alias("p25"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id FROM events JOIN q USING (event_type) WHERE value > b + 1.5 * (b - a)""")
def iqr_outliers(t: Tables) -> DataFrame:
    """AG-27 in part: the fence alone."""
    q = ranks.quantiles(t.events, "event_type", "value", "event_id", {"a": 0.25, "b": 0.75})
    return t.events.join(q, "event_type").where("value > b + 1.5 * (b - a)").select("event_id")


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM events GROUP BY 1")
def weekly_counts(t: Tables) -> DataFrame:
    """AG-28"""
    week = F.concat(F.expr("extract(YEAROFWEEK FROM ts)"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return t.events.groupBy(week.alias("week")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS open, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last FROM events GROUP BY 1)
    SELECT *, date_diff('day', last, (SELECT max(last) FROM g)) >= 2 AND open > 0 AS stalled FROM g""")  # fmt: skip
def panorama(t: Tables) -> DataFrame:
    """AG-29 and WN-52's reference day: idle since the latest day of all."""
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("open"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    latest = t.events.agg(F.to_date(F.max("ts")).alias("now"))  # one row
    return g.join(F.broadcast(latest)).select("user_id", "n", "open", "first", "last", ((F.datediff("now", "last") >= 2) & (F.col("open") > 0)).alias("stalled"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, event_type AS winner, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1")
def majority_vote(t: Tables) -> DataFrame:
    """AG-30: ties go to the label seen first."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return c.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", -F.col("seen"))).alias("w")).select("user_id", F.col("w.event_type").alias("winner"), "w.n")


@query("""WITH s AS (SELECT user_id, value, event_id AS priority, event_id % 7 AS trust FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, round(value, 4) AS v, count(*) AS c FROM s GROUP BY 1, 2),
    m AS (SELECT user_id, v AS majority FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, v) = 1)
    SELECT user_id, count(*) AS n, arg_min(value, priority) AS primary_first, round(median(value), 4) AS median, round(avg(value), 7) AS mean, any_value(majority) AS majority, arg_max(value, trust * 1000000000 - priority) AS trusted FROM s JOIN m USING (user_id) GROUP BY 1""")  # fmt: skip
def consensus(t: Tables) -> DataFrame:
    """AG-31"""
    s = t.events.where("event_type = 'purchase'").select("user_id", "value", F.col("event_id").alias("priority"), (F.col("event_id") % 7).alias("trust"))
    return reconcile.consensus(s, ["user_id"]).select("user_id", "n", F.col("primary").alias("primary_first"), F.round("median", 4).alias("median"), F.round("mean", 7).alias("mean"), "majority", "trusted")


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 5) AS p FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, CASE WHEN n < 2 THEN 'RED' WHEN p >= n - 1 THEN 'GREEN' WHEN p > 0 THEN 'YELLOW' ELSE 'RED' END AS light FROM g""")
def traffic_lights(t: Tables) -> DataFrame:
    """AG-32"""
    g = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 5).alias("p"))
    return g.select("user_id", reconcile.traffic_light(F.col("n"), F.col("p")).alias("light"))


@query("""WITH g AS (SELECT source, avg(CAST(n_chars < 200 AS INT)) AS short, avg(CAST(contains(text, '|') AS INT)) AS tabular, avg(CAST(lang <> 'en' AS INT)) AS foreign_share FROM documents GROUP BY 1)
    SELECT source, round(short + tabular + foreign_share, 6) AS risk, CASE WHEN short + tabular + foreign_share >= 0.9 THEN 'HIGH' WHEN short + tabular + foreign_share >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM g""")  # fmt: skip
def corpus_risk(t: Tables) -> DataFrame:
    """AG-33"""
    share = lambda c: F.avg(c.cast("int"))
    risk = share(F.col("n_chars") < 200) + share(F.contains("text", F.lit("|"))) + share(F.col("lang") != "en")
    return t.documents.groupBy("source").agg(risk.alias("r")).select("source", F.round("r", 6).alias("risk"), F.when(F.col("r") >= 0.9, "HIGH").when(F.col("r") >= 0.5, "MEDIUM").otherwise("LOW").alias("band"))


@query("SELECT conv_id, list_sort(list(DISTINCT role)) AS roles, count(*) AS turns, arg_max(role, turn) AS last_role, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'answered' ELSE 'owed' END AS state FROM conversations GROUP BY 1")
def reply_state(t: Tables) -> DataFrame:
    """AG-34, AG-35 and AG-42"""
    last = F.max_by("role", "turn")
    return t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count("*").alias("turns"), last.alias("last_role"), F.when(last == "assistant", "answered").otherwise("owed").alias("state"))


@query("SELECT sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS h, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_text_copies(t: Tables) -> DataFrame:
    """AG-36 and AG-37: equal texts but for case and white space."""
    h = F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))), 256)
    return t.documents.select(h.alias("h"), "doc_id").groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper")).where("copies > 1")


@query("WITH g AS (SELECT s_suppkey, avg(l_discount) AS m FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) SELECT s_suppkey, round(m, 6) AS m, rank() OVER (ORDER BY round(m, 9) DESC) AS place FROM g")
def peer_ranking(t: Tables) -> DataFrame:
    """AG-38: a rank over suppliers, a dimension, after the facts are grouped."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_discount").alias("m")).join(t.supplier, "s_suppkey", "left_semi")
    ranked = ranks.competition_rank(g.withColumn("less", -F.round("m", 9)), "less", "s_suppkey", "nth")
    return ranked.select("s_suppkey", F.round("m", 6).alias("m"), F.col("nth").cast("long").alias("place"))


@query("""WITH w AS (SELECT DISTINCT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS word FROM part), n AS (SELECT p_brand, word, count(*) AS c FROM w GROUP BY 1, 2), s AS (SELECT word, count(*) AS total FROM w GROUP BY 1)
    SELECT p_brand, word, round(c / total, 6) AS score FROM n JOIN s USING (word) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY c / total DESC, word) <= 3""")  # fmt: skip
def keyword_candidates(t: Tables) -> DataFrame:
    """AG-39 and ST-04"""
    w = t.part.select("p_partkey", "p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    n, total = w.groupBy("p_brand", "word").agg(F.count("*").alias("c")), w.groupBy("word").agg(F.count("*").alias("total"))
    x = n.join(total, "word").withColumn("score", F.col("c") / F.col("total"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "word"))).where("k <= 3").select("p_brand", "word", F.round("score", 6).alias("score"))


@query("SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ROLLUP (source)")
def completeness(t: Tables) -> DataFrame:
    """AG-40: by source and in all."""
    l = t.labels.select("doc_id", F.lit(1).alias("has")).distinct()  # noqa: E741
    return t.documents.select("doc_id", "source").join(l, "doc_id", "left").rollup("source").agg(F.count("*").alias("docs"), F.count("has").alias("labelled"), F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(t: Tables) -> DataFrame:
    """ST-01, ST-02 and ST-05"""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT doc_id, quality <> toxic AS disagree FROM labels ORDER BY quality <> toxic DESC, doc_id LIMIT 50")
def review_queue(t: Tables) -> DataFrame:
    """ST-06 and ST-08: disagreement first, a budget of 50."""
    return t.labels.select("doc_id", (F.col("quality") != F.col("toxic")).alias("disagree")).orderBy(F.desc("disagree"), "doc_id").limit(50)


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_with_missing(t: Tables) -> DataFrame:
    """SO-01 and SO-02"""
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("SELECT 'old' AS origin, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'new', o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 10 = 0")
def replace_by_key(t: Tables) -> DataFrame:
    """SO-03"""
    new = t.orders.where("o_orderkey % 10 = 0").select(F.lit("new").alias("origin"), "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return t.orders.select(F.lit("old").alias("origin"), "o_orderkey", "o_totalprice").join(new, "o_orderkey", "left_anti").unionByName(new)


@query("SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'removed', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_difference(t: Tables) -> DataFrame:
    """SO-04, SO-06 and SO-07"""
    f, p = (t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP")
    return f.intersect(p).select(F.lit("both").alias("side"), "k").unionByName(f.subtract(p).select(F.lit("removed").alias("side"), "k"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    """A wide aggregate with its filter pushed into the scan."""
    x = t.lineitem.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def revenue_by_nation(t: Tables) -> DataFrame:
    """A star join: facts join facts by shuffle or broadcast as their sizes say."""
    x = t.lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    return x.join(t.customer, "c_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))
