"""Audits of cases, sources and tables, and rankings of peers: the standard tables stand in for mail, filings and parsed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranks
from tessera.operators import windows as w
from tessera.plans.process import flow_verdicts
from tessera.plans.registry import ORACLES, Tables, query
from tessera.plans.timeseries import PANEL, panel


def _flows(t: Tables) -> DataFrame:
    x = panel(t).withColumn("dv", F.col("close") * F.col("volume"))
    return x.select("ticker", "d", "dv", F.try_divide(F.col("dv"), F.avg("dv").over(w.frame(20))).alias("ratio"), *[w.simple_return("close", n).alias(f"r{n}") for n in (1, 5, 20)])


_FLOWS = f"""WITH {PANEL}, v AS (SELECT *, close * volume AS dv FROM panel), x AS (
        SELECT ticker, d, dv, dv / avg(dv) OVER (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING) AS ratio, close / lag(close, 1) OVER o - 1 AS r1, close / lag(close, 5) OVER o - 1 AS r5, close / lag(close, 20) OVER o - 1 AS r20
        FROM v WINDOW o AS (PARTITION BY ticker ORDER BY d)),
    s AS (SELECT d, max(r5) FILTER (ticker = 'F1') - max(r5) FILTER (ticker = 'O1') AS risk_on_off, max(r1) FILTER (ticker = 'F2') - max(r1) FILTER (ticker = 'O2') AS credit,
        max(r20) FILTER (ticker = 'F3') - max(r20) FILTER (ticker = 'O3') AS growth, max(ratio) FILTER (ticker = 'F4') / nullif(max(ratio) FILTER (ticker = 'F1'), 0) AS rotation,
        max(r5) FILTER (ticker = 'F5') / nullif(max(r5) FILTER (ticker = 'O5'), 0) AS sector, coalesce(sum(dv) FILTER (ticker IN ('P1', 'P2')), 0) AS cash,
        coalesce(sum(dv) FILTER (ticker IN ('P3', 'P4', 'P5')), 0) AS hedge, max(ratio) FILTER (ticker = 'O4') AS abroad FROM x GROUP BY d)"""
_SIGNALS = ("risk_on_off", "credit", "growth", "rotation", "sector", "cash", "hedge", "abroad")


@query(f"{_FLOWS} SELECT d, {', '.join(f'round({k}, 5) AS {k}' for k in _SIGNALS)}, CASE WHEN risk_on_off > 0.005 THEN 'RISK_ON' WHEN risk_on_off < -0.005 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM s")
def composite_suite(t: Tables) -> DataFrame:
    """WN-23: eight signals of a day from pairs and groups of tickers, and its regime."""
    of = lambda column, ticker: F.max(F.when(F.col("ticker") == ticker, F.col(column)))
    total = lambda *tickers: F.coalesce(F.sum(F.when(F.col("ticker").isin(*tickers), F.col("dv"))), F.lit(0.0))
    s = _flows(t).groupBy("d").agg(
        (of("r5", "F1") - of("r5", "O1")).alias("risk_on_off"), (of("r1", "F2") - of("r1", "O2")).alias("credit"), (of("r20", "F3") - of("r20", "O3")).alias("growth"),
        F.try_divide(of("ratio", "F4"), of("ratio", "F1")).alias("rotation"), F.try_divide(of("r5", "F5"), of("r5", "O5")).alias("sector"),
        total("P1", "P2").alias("cash"), total("P3", "P4", "P5").alias("hedge"), of("ratio", "O4").alias("abroad"),
    )
    regime = F.when(F.col("risk_on_off") > 0.005, "RISK_ON").when(F.col("risk_on_off") < -0.005, "RISK_OFF").otherwise("NEUTRAL")
    return s.select("d", *[F.round(k, 5).alias(k) for k in _SIGNALS], regime.alias("regime"))


_PERIODS = {"1": 12, "2": 52, "3": 4}


@query(f"""WITH {PANEL}, x AS (SELECT ticker, d, close, lag(close) OVER o AS before, CASE substr(ticker, 2) WHEN '1' THEN lag(close, 12) OVER o WHEN '2' THEN lag(close, 52) OVER o WHEN '3' THEN lag(close, 4) OVER o ELSE lag(close, 252) OVER o END AS year_before
        FROM panel WINDOW o AS (PARTITION BY ticker ORDER BY d))
    SELECT ticker, d, round(close, 4) AS level, round((close / before - 1) * 100, 4) AS mom, round((close / year_before - 1) * 100, 4) AS yoy FROM x""")  # fmt: skip
def period_changes(t: Tables) -> DataFrame:
    """WN-25: level, change on the period before and on the year before, where a series has 12, 52, 4 or 252 periods a year."""
    kind = F.substring("ticker", 2, 1)
    yoy = F.when(F.lit(False), F.lit(0.0))
    for k, n in _PERIODS.items():
        yoy = yoy.when(kind == k, w.simple_return("close", n))
    yoy = yoy.otherwise(w.simple_return("close", 252))
    return panel(t).select("ticker", "d", F.round("close", 4).alias("level"), F.round(100 * w.simple_return("close", 1), 4).alias("mom"), F.round(100 * yoy, 4).alias("yoy"))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) FILTER (event_type = 'error') AS reminders, count(*) FILTER (event_type IN ('view', 'error')) > 0 AND count(*) FILTER (event_type = 'purchase') = 0 AS undelivered FROM events GROUP BY 1, 2)
    SELECT user_id, d, reminders, CASE WHEN undelivered THEN 'NO_DELIVERY' ELSE 'MANY_REMINDERS' END AS reason FROM g WHERE reminders >= 2 OR undelivered""")  # fmt: skip
def reminder_loops(t: Tables) -> DataFrame:
    """PMN-10: cases with two reminders or more, and asked-for cases without a delivery. A user's day is a case, errors are reminders, views requests."""
    kind = F.col("event_type")
    g = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count_if(kind == "error").alias("reminders"), ((F.count_if(kind.isin("view", "error")) > 0) & (F.count_if(kind == "purchase") == 0)).alias("undelivered"))
    return g.where("reminders >= 2 OR undelivered").select("user_id", "d", "reminders", F.when(F.col("undelivered"), "NO_DELIVERY").otherwise("MANY_REMINDERS").alias("reason"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), g AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS last, count(*) FILTER (event_type <> 'purchase' AND event_id % 3 <> 0) AS open,
        count(*) FILTER (event_type IN ('view', 'error') AND event_id % 3 <> 0 AND ts < now - INTERVAL 48 HOUR) AS stale, count(*) FILTER (event_type = 'purchase') AS delivered, max(now) AS now FROM events, n GROUP BY 1),
    f AS (SELECT user_id, 'DELAY' AS kind, open AS n FROM g WHERE open > 0 AND now - last >= INTERVAL 72 HOUR UNION ALL SELECT user_id, 'NO_REPLY', stale FROM g WHERE stale > 0 UNION ALL SELECT user_id, 'MISMATCH', open FROM g WHERE delivered > 0 AND open > 0)
    SELECT user_id, kind, n FROM f WHERE NOT (user_id % 5 = 0 AND kind = 'NO_REPLY')""")  # fmt: skip
def new_exceptions(t: Tables) -> DataFrame:
    """PMN-12: late, unanswered and mismatched cases, without those that are open already. An error is the last contact; every fifth user's missing reply was reported before."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    kind, is_open = F.col("event_type"), F.col("event_id") % 3 != 0
    g = e.groupBy("user_id").agg(
        F.max(F.when(kind == "error", F.col("ts"))).alias("last"), F.max("now").alias("now"), F.count_if((kind != "purchase") & is_open).alias("open"), F.count_if(kind == "purchase").alias("delivered"),
        F.count_if(kind.isin("view", "error") & is_open & (F.col("ts") < F.col("now") - F.expr("interval 48 hours"))).alias("stale"),
    )
    found = F.array(
        F.when((F.col("open") > 0) & (F.col("last") <= F.col("now") - F.expr("interval 72 hours")), F.struct(F.lit("DELAY").alias("kind"), F.col("open").alias("n"))),
        F.when(F.col("stale") > 0, F.struct(F.lit("NO_REPLY").alias("kind"), F.col("stale").alias("n"))),
        F.when((F.col("delivered") > 0) & (F.col("open") > 0), F.struct(F.lit("MISMATCH").alias("kind"), F.col("open").alias("n"))),
    )
    reported = t.events.where("user_id % 5 = 0").select("user_id", F.lit("NO_REPLY").alias("kind")).distinct()
    return g.select("user_id", F.explode(F.array_compact(found)).alias("f")).select("user_id", "f.kind", "f.n").join(reported, ["user_id", "kind"], "left_anti")


@query("""WITH m AS (SELECT user_id, max(value) AS v, user_id % 11 = 0 AS bulk FROM events GROUP BY 1), l AS (SELECT list(v ORDER BY v) AS l FROM m WHERE NOT bulk),
    f AS (SELECT len(l) AS n, l[len(l) * 3 // 4 + 1] + 1.5 * (l[len(l) * 3 // 4 + 1] - l[len(l) // 4 + 1]) AS fence FROM l)
    SELECT user_id, CASE WHEN bulk THEN 'bulk' ELSE 'person' END AS kind, CASE WHEN bulk THEN 'excluded' WHEN n < 4 THEN 'sample too small' WHEN v > fence THEN 'outlier' ELSE '' END AS verdict FROM m, f""")  # fmt: skip
def latency_outliers(t: Tables) -> DataFrame:
    """AG-27: people above the fence of quartiles by place; bulk senders (every eleventh user) neither count nor are judged, and under four people nobody is."""
    m = t.events.groupBy("user_id").agg(F.max("value").alias("v")).withColumn("kind", F.when(F.col("user_id") % 11 == 0, "bulk").otherwise("person"))
    at = ranks.positions(m.where("kind = 'person'"), "kind", "v", "user_id")
    q = lambda e: F.max(F.when(F.col("place") == F.expr(e), F.col("v")))
    fence = at.groupBy("kind").agg(F.max("size").alias("n"), (q("size * 3 div 4") + 1.5 * (q("size * 3 div 4") - q("size div 4"))).alias("fence"))  # one row
    verdict = F.when(F.col("kind") == "bulk", "excluded").when(F.col("n") < 4, "sample too small").when(F.col("v") > F.col("fence"), "outlier").otherwise("")
    return m.join(F.broadcast(fence), "kind", "left").select("user_id", "kind", verdict.alias("verdict"))


@query("""WITH g AS (SELECT l_suppkey AS k, CAST(count(*) AS DOUBLE) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(max(l_extendedprice) AS DOUBLE) AS largest FROM lineitem GROUP BY 1),
    u AS (SELECT k, unnest(['lines', 'quantity', 'largest']) AS metric, unnest([lines, quantity, largest]) AS v FROM g), s AS (SELECT metric, list(v ORDER BY v) AS l FROM u GROUP BY 1)
    SELECT k, metric, v, rank() OVER (PARTITION BY metric ORDER BY v DESC) AS place, l[len(l) // 2 + 1] AS median FROM u JOIN s USING (metric)""")  # fmt: skip
def peer_table(t: Tables) -> DataFrame:
    """AG-38: each supplier's place among its peers (one more than the number above it) and the metric's median by place, from range partitions."""
    as_double = lambda c, name: c.cast("double").alias(name)
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(as_double(F.count("*"), "lines"), as_double(F.sum("l_quantity"), "quantity"), as_double(F.max("l_extendedprice"), "largest"))
    at = ranks.positions(g.unpivot(["k"], ["lines", "quantity", "largest"], "metric", "v"), "metric", "v", "k")
    tie = at.groupBy("metric", "v").agg((F.max("size") - F.max("place")).alias("place"))
    median = at.where("place = size div 2").select("metric", F.col("v").alias("median"))
    return at.select("k", "metric", "v").join(tie, ["metric", "v"]).join(median, "metric").select("k", "metric", "v", "place", "median")


_FATE = "CASE WHEN doc_id % 211 = 0 THEN 'lost' WHEN doc_id % 101 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'structural' WHEN doc_id % 17 = 0 THEN 'recoverable' ELSE 'extracted' END"


@query(f"""WITH x AS (SELECT source, {_FATE} AS fate FROM documents), g AS (SELECT source, count(*) AS seen, count(*) FILTER (fate = 'extracted') AS extracted, count(*) FILTER (fate IN ('error', 'structural', 'recoverable')) AS failed,
        count(*) FILTER (fate = 'error') AS errors, count(*) FILTER (fate IN ('extracted', 'recoverable', 'error')) AS due FROM x GROUP BY ROLLUP (source))
    SELECT source, seen, extracted, CASE WHEN due = 0 THEN 100.0 ELSE round(extracted / due * 100, 1) END AS coverage, greatest(seen - extracted - failed, 0) AS gap, CASE WHEN seen > extracted + failed THEN 'FAIL' WHEN errors > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM g""")  # fmt: skip
def source_audit(t: Tables) -> DataFrame:
    """AG-40: coverage without what is left out by its structure, rows that nothing explains, and a status, by source and in all."""
    fate, n = F.col("fate"), lambda *kinds: F.count_if(F.col("fate").isin(*kinds))
    g = t.documents.select("source", F.expr(_FATE).alias("fate")).rollup("source").agg(
        F.count("*").alias("seen"), F.count_if(fate == "extracted").alias("extracted"), n("error", "structural", "recoverable").alias("failed"), n("error").alias("errors"), n("extracted", "recoverable", "error").alias("due"),
    )
    gap = F.greatest(F.col("seen") - F.col("extracted") - F.col("failed"), F.lit(0))
    coverage = F.coalesce(F.round(F.try_divide("extracted", "due") * 100, 1), F.lit(100.0))
    return g.select("source", "seen", "extracted", coverage.alias("coverage"), gap.alias("gap"), F.when(gap > 0, "FAIL").when(F.col("errors") > 0, "WARN").otherwise("PASS").alias("status"))


@query("""WITH x AS (SELECT event_id, count(*) OVER k AS copies, row_number() OVER (k ORDER BY ts DESC, event_id DESC) AS place FROM events WINDOW k AS (PARTITION BY user_id, event_type, CAST(ts AS DATE)))
    SELECT event_id, copies, place, CASE WHEN place = 1 THEN 'kept' ELSE 'quarantined' END AS state FROM x WHERE copies > 1""")  # fmt: skip
def quarantine_split(t: Tables) -> DataFrame:
    """AG-08 and AG-09: of rows that share a key the last stays; the rest go to quarantine with their place in the key."""
    key = Window.partitionBy("user_id", "event_type", F.to_date("ts"))
    x = t.events.select("event_id", F.count("*").over(key).alias("copies"), F.row_number().over(key.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("place"))
    return x.where("copies > 1").withColumn("state", F.when(F.col("place") == 1, "kept").otherwise("quarantined"))


@query("""WITH c AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS BIGINT) AS yr, o_orderstatus AS source, count(*) AS available FROM orders GROUP BY 1, 2, 3)
    SELECT company, yr, source, available FROM c QUALIFY row_number() OVER (PARTITION BY company, yr ORDER BY CASE source WHEN 'P' THEN 1 ELSE 2 END, available DESC, source) = 1""")  # fmt: skip
def best_source(t: Tables) -> DataFrame:
    """AG-07: a company's source for a year by rank of sources (P before F and O), then by how much it holds, then by name."""
    c = t.orders.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("long").alias("yr"), F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("available"))
    first = F.min(F.struct(F.when(F.col("source") == "P", 1).otherwise(2).alias("rank"), (-F.col("available")).alias("less"), "source", "available"))
    return c.groupBy("company", "yr").agg(first.alias("b")).select("company", "yr", "b.source", "b.available")


_CELLS = "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS a, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS b, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS c"


@query(f"""WITH x AS (SELECT p_size AS tab, p_partkey AS line, {_CELLS} FROM part), n AS (SELECT tab, line, nullif(a, '') AS a, nullif(b, '') AS b, nullif(c, '') AS c FROM x),
    f AS (SELECT tab, line, last_value(a IGNORE NULLS) OVER o AS a, last_value(b IGNORE NULLS) OVER o AS b, last_value(c IGNORE NULLS) OVER o AS c FROM n WINDOW o AS (PARTITION BY tab ORDER BY line ROWS UNBOUNDED PRECEDING))
    SELECT tab, line, [coalesce(f.a, ''), coalesce(f.b, ''), coalesce(f.c, '')] AS down, [coalesce(n.a, ''), coalesce(n.b, n.a, ''), coalesce(n.c, n.b, n.a, '')] AS across FROM f JOIN (SELECT tab, line, a, b, c FROM n) n USING (tab, line)""")  # fmt: skip
def table_fills(t: Tables) -> DataFrame:
    """WN-49: empty cells take the value above them (merged rows), or the one to their left (merged columns); what has neither is empty."""
    x = t.part.selectExpr("p_size AS tab", "p_partkey AS line", *_CELLS.split(", ")).select("tab", "line", *[F.nullif(F.col(k), F.lit("")).alias(k) for k in "abc"])
    empty = F.lit("")
    x = x.withColumn("across", F.array(F.coalesce("a", empty), F.coalesce("b", "a", empty), F.coalesce("c", "b", "a", empty)))
    filled = ranks.fill_down(x, "tab", "line", ["a", "b", "c"])
    return filled.select("tab", "line", F.array(*[F.coalesce(k, empty) for k in "abc"]).alias("down"), "across")


# The ladder of steps and the number of intervals of an axis.
STEPS, INTERVALS = (1.0, 2.0, 2.5, 5.0, 10.0), 4


@query(f"""WITH {PANEL}, r AS (SELECT ticker, min(low) AS lo, CASE WHEN max(high) > min(low) THEN max(high) ELSE min(low) + 1 END AS hi FROM panel GROUP BY 1), e AS (SELECT *, floor(log10((hi - lo) / {INTERVALS})) AS e FROM r),
    c AS (SELECT ticker, lo, hi, unnest([{", ".join(f"{s} * power(10.0::DOUBLE, e + {m})" for m in (0, 1, 2) for s in STEPS)}]) AS step FROM e),
    m AS (SELECT ticker, any_value(lo) AS lo, min(step) AS step FROM c WHERE step >= (hi - lo) / {INTERVALS} AND floor(lo / step) * step + step * {INTERVALS} >= hi GROUP BY 1)
    SELECT ticker, step, [round(floor(lo / step) * step + step * k, 6) FOR k IN range({INTERVALS + 1})] AS ticks FROM m""")  # fmt: skip
def axis_ticks(t: Tables) -> DataFrame:
    """FN-18: five ticks per ticker on the least step of the ladder whose grid covers the lowest and the highest price."""
    r = panel(t).groupBy("ticker").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1))
    raw = (F.col("hi") - F.col("lo")) / INTERVALS
    first = lambda s: F.floor(F.col("lo") / s) * s
    ladder = F.array(*[s * F.pow(F.lit(10.0), F.floor(F.log10("raw")) + m) for m in (0, 1, 2) for s in STEPS])
    fits = lambda s: (s >= F.col("raw")) & (first(s) + s * INTERVALS >= F.col("hi"))
    x = r.withColumn("raw", raw).withColumn("step", F.array_min(F.filter(ladder, fits)))
    return x.select("ticker", "step", F.array(*[F.round(first(F.col("step")) + F.col("step") * k, 6) for k in range(INTERVALS + 1)]).alias("ticks"))


@query("""WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') % 4 + count(DISTINCT event_type) FILTER (event_type IN ('click', 'error')) * 2 + count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'error') % 3 - 2 AS score FROM events GROUP BY 1)
    SELECT user_id, score, CASE WHEN score >= 6 THEN 'High' WHEN score >= 3 THEN 'Medium' ELSE 'Low' END AS influence FROM g""")  # fmt: skip
def influence(t: Tables) -> DataFrame:
    """FN-22: interactions, twice the domains and the tickets of a person. Purchases, kinds of event and days with errors stand in, brought down to small numbers so that all levels occur."""
    kind = F.col("event_type")
    score = F.count_if(kind == "purchase") % 4 + F.count_distinct(F.when(kind.isin("click", "error"), kind)) * 2 + F.count_distinct(F.when(kind == "error", F.to_date("ts"))) % 3 - 2
    g = t.events.groupBy("user_id").agg(score.alias("score"))
    return g.select("user_id", "score", F.when(F.col("score") >= 6, "High").when(F.col("score") >= 3, "Medium").otherwise("Low").alias("influence"))


@query("""WITH f AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT c_custkey AS k, c_nationkey AS n, f.n AS n_cons, f.v AS v_cons, o.n AS n_calc, o.v AS v_calc FROM customer LEFT JOIN f ON f.k = c_custkey LEFT JOIN o ON o.k = c_custkey""")  # fmt: skip
def suffix_chain(t: Tables) -> DataFrame:
    """JN-02: a chain of left joins in which names that clash get their source's suffix."""
    side = lambda status, suffix: t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(f"n{suffix}"), F.round(F.sum("o_totalprice"), 2).alias(f"v{suffix}"))
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return base.join(side("F", "_cons"), "k", "left").join(side("O", "_calc"), "k", "left")


@query(f"SELECT verdict, count(*) AS cases, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({ORACLES['flow_verdicts']}) GROUP BY 1")
def verdict_counters(t: Tables) -> DataFrame:
    """AG-41: cases by verdict and their share of all."""
    c = flow_verdicts(t).groupBy("verdict").agg(F.count("*").alias("cases"))
    return c.join(F.broadcast(c.agg(F.sum("cases").alias("all")))).select("verdict", "cases", F.round(F.col("cases") / F.col("all"), 6).alias("share"))  # one row per verdict
