"""More of the price panel: risk statistics, snapshots, correlations, coefficients of information, events and ranks of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import market as m
from tessera.plans.registry import Tables, query
from tessera.plans.timeseries import PANEL, panel

_RETURNS = f"{PANEL}, r AS (SELECT ticker, d, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM panel)"
_RF = "(pow(1.02, 1.0 / 252) - 1)"


def returns(t: Tables) -> DataFrame:
    return m.returns(panel(t))


@query(f"""WITH {_RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM r), win(label, w) AS (VALUES ('20', 20), ('60', 60), ('120', 120), ('YTD', NULL)),
    x AS (SELECT a.ticker, label, a.r, b.r AS b FROM k a JOIN win ON CASE WHEN w IS NULL THEN a.d >= DATE '1998-01-01' ELSE a.rn <= w END LEFT JOIN k b ON b.ticker = 'O1' AND b.d = a.d AND (w IS NULL OR b.rn <= w) WHERE a.r IS NOT NULL)
    SELECT ticker, label AS win, count(*) AS n, round(stddev_samp(r), 6) AS stddev_d, round(stddev_samp(r) * sqrt(252), 6) AS vol_ann, round((avg(r) - {_RF}) / stddev_samp(r) * sqrt(252), 4) AS sharpe,
        CASE WHEN count(b) >= 3 THEN round(regr_slope(r, b), 4) END AS beta, CASE WHEN count(b) >= 3 THEN round(corr(r, b), 4) END AS correl FROM x GROUP BY 1, 2 HAVING count(*) >= 3""")  # fmt: skip
def risk_statistics(t: Tables) -> DataFrame:
    """AG-14 and JN-17: deviation, volatility, Sharpe ratio, beta and correlation with a benchmark over the last bars and the year to date."""
    return m.risk_statistics(returns(t), "O1", (20, 60, 120), "1998-01-01", 0.02)


_SNAP = ", ".join([f"CASE WHEN count(*) >= {w} THEN round(avg(p) FILTER (rn <= {w}), 4) END AS sma_{w}" for w in (5, 20, 60)] + [f"CASE WHEN count(*) >= {w} THEN round(avg(volume) FILTER (rn <= {w}), 4) END AS avg_vol_{w}" for w in (60, 120)])


@query(f"""WITH {PANEL}, s AS (SELECT *, CASE WHEN count(adj_close) OVER (PARTITION BY ticker) > 0 THEN adj_close ELSE close END AS p, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM panel)
    SELECT ticker, {_SNAP}, round((max(p) FILTER (rn = 1) / nullif(arg_min(coalesce(p, 0), d) FILTER (d >= DATE '1998-01-01'), 0) - 1) * 100, 4) AS ytd_pct, round(max(p) FILTER (rn = 1), 4) AS adj_close,
        max(volume) FILTER (rn = 1) AS volume, round(max(p) FILTER (rn = 1) * 1000, 2) AS market_cap FROM s GROUP BY 1""")  # fmt: skip
def market_snapshot(t: Tables) -> DataFrame:
    """AG-15 and PRJ-03: means of the last bars (null where there are fewer), year to date, last price (adjusted if a ticker has any) and market value."""
    return m.snapshot(panel(t), (5, 20, 60), (60, 120), "1998-01-01", 1000)


@query(f"""WITH {_RETURNS}, mk AS (SELECT d, avg(r) AS m FROM r GROUP BY 1), x AS (SELECT ticker, d, r, m FROM r JOIN mk USING (d) WHERE r IS NOT NULL AND m IS NOT NULL), b AS (SELECT ticker, regr_slope(r, m) AS beta FROM x GROUP BY 1)
    SELECT ticker, d, round(r - beta * m, 6) AS rest FROM x JOIN b USING (ticker)""")  # fmt: skip
def beta_removed(t: Tables) -> DataFrame:
    """AG-19: returns less beta times the market's."""
    return m.beta_removed(returns(t))


_PAIRED = f"WITH {_RETURNS}, x AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS c FROM r a JOIN r b ON a.d = b.d AND a.ticker < b.ticker AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(f"{_PAIRED} SELECT a, b, round(c, 5) AS c, round(avg(c) OVER (), 5) AS mean_c FROM x")
def correlation_matrix(t: Tables) -> DataFrame:
    """AG-16: correlations of returns above the diagonal, and their mean; pairs are of tickers, summed from their common days."""
    pairs = m.correlations(returns(t))
    return pairs.crossJoin(pairs.agg(F.avg("c").alias("mean_c"))).select("a", "b", F.round("c", 5).alias("c"), F.round("mean_c", 5).alias("mean_c"))


@query(f"""WITH {_RETURNS}, mk AS (SELECT d, avg(r) AS m FROM r GROUP BY 1), x AS (SELECT ticker, r, m FROM r JOIN mk USING (d) WHERE r IS NOT NULL AND m IS NOT NULL),
    f AS (SELECT ticker, regr_count(r, m) AS n, regr_intercept(r, m) AS alpha, regr_slope(r, m) AS beta, regr_sxx(r, m) AS sxx, regr_syy(r, m) AS syy, regr_sxy(r, m) AS sxy, regr_avgx(r, m) AS mx FROM x GROUP BY 1)
    SELECT ticker, round(alpha, 6) AS alpha, round(beta, 5) AS beta, round(alpha / sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS t FROM f WHERE n > 2""")  # fmt: skip
def factor_alpha(t: Tables) -> DataFrame:
    """AG-18: alpha against the market with its t-statistic."""
    return m.factor_alpha(returns(t))


def _rank_sql(c: str) -> str:
    return f"rank() OVER (PARTITION BY d ORDER BY {c}) + (count(*) OVER (PARTITION BY d, {c}) - 1) / 2.0"


@query(f"""WITH {_RETURNS}, s AS (SELECT ticker, d, r AS s, lead(r) OVER (PARTITION BY ticker ORDER BY d) AS f FROM r), k AS (SELECT d, {_rank_sql("s")} AS a, {_rank_sql("f")} AS b FROM s WHERE s IS NOT NULL AND f IS NOT NULL),
    ic AS (SELECT d, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 5)
    SELECT count(ic) AS days, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 4) AS t FROM ic WHERE NOT isnan(ic)""")  # fmt: skip
def daily_information(t: Tables) -> DataFrame:
    """AG-23: rank correlation of signal and next return over the tickers of each day with five at least, its mean and t."""
    s = returns(t).withColumn("f", F.lead("r").over(Window.partitionBy("ticker").orderBy("d"))).withColumnRenamed("r", "s")
    return m.daily_information(s, 5)


@query(f"""WITH {_RETURNS}, b AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i, r > 1 AS p, r < -0.5 AS q FROM r), p AS (SELECT ticker, i FROM b WHERE p), q AS (SELECT ticker, i FROM b WHERE q),
    hp AS (SELECT ticker, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM q WHERE q.ticker = p.ticker AND abs(q.i - p.i) <= 2)) AS hit FROM p GROUP BY 1),
    hq AS (SELECT ticker, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE q.ticker = p.ticker AND abs(q.i - p.i) <= 2)) AS hit FROM q GROUP BY 1)
    SELECT ticker, round(hp.hit / hp.n, 6) AS prec, round(hq.hit / hq.n, 6) AS rec, round(CASE WHEN hp.hit + hq.hit = 0 THEN 0.0 ELSE 2 * (hp.hit / hp.n) * (hq.hit / hq.n) / (hp.hit / hp.n + hq.hit / hq.n) END, 6) AS f1 FROM hp JOIN hq USING (ticker)""")  # fmt: skip
def event_scores(t: Tables) -> DataFrame:
    """AG-25: precision, recall and F1 of predicted bars against true ones, two bars off at most."""
    b = returns(t).withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy("d")))
    return m.event_scores(b.where("r > 1").select("ticker", "i"), b.where("r < -0.5").select("ticker", "i"), 2)


_LAGS = (-10, -5, -3, -1, 0, 1, 3, 5, 10)


@query(f"""WITH {_RETURNS}, n AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM r)), x AS (SELECT ticker, i, r FROM r JOIN n USING (d) WHERE r IS NOT NULL)
    SELECT a.ticker AS a, b.ticker AS b, lag, count(*) AS n, round(corr(a.r, b.r), 5) AS c FROM x a JOIN (SELECT unnest([{", ".join(map(str, _LAGS))}]) AS lag) ON true JOIN x b ON b.ticker <> a.ticker AND b.i = a.i + lag GROUP BY 1, 2, 3 HAVING count(*) >= 10""")  # fmt: skip
def lead_lag_pairs(t: Tables) -> DataFrame:
    """JN-21 and WN-20: correlation of every ordered pair of tickers at nine lags of the common calendar."""
    return m.lagged_correlations(returns(t), _LAGS, 10).withColumn("c", F.round("c", 5))


@query(f"""WITH {_RETURNS}, n AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM r)), x AS (SELECT ticker, i, r FROM r JOIN n USING (d) WHERE r IS NOT NULL AND d >= DATE '1997-06-01'),
    c AS (SELECT a.ticker AS a, b.ticker AS b, lag, round(corr(a.r, b.r), 5) AS c FROM x a JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS lag) ON true JOIN x b ON b.ticker <> a.ticker AND b.i = a.i + lag GROUP BY 1, 2, 3 HAVING count(*) >= 10)
    SELECT a, b, lag, c FROM c WHERE c IS NOT NULL AND NOT isnan(c) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY c DESC, lag) = 1""")  # fmt: skip
def leaders(t: Tables) -> DataFrame:
    """WN-43: the lag of 0 to 5 bars at which a ticker leads another most; of equal ones the shortest."""
    c = m.lagged_correlations(returns(t).where("d >= date'1997-06-01'"), range(6), 10, returns(t)).withColumn("c", F.round("c", 5)).where("c is not null and not isnan(c)")
    return c.groupBy("a", "b").agg(F.max(F.struct("c", (-F.col("lag")).alias("l"))).alias("x")).select("a", "b", (-F.col("x.l")).alias("lag"), "x.c")


@query(f"""WITH {PANEL}, p AS (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM panel), w AS (SELECT ticker, arg_min(d, (close / peak - 1, d)) AS trough, min(close / peak - 1) AS dd, arg_min(peak, (close / peak - 1, d)) AS top FROM p GROUP BY 1),
    f AS (SELECT w.*, max(p.d) FILTER (p.d <= trough AND p.close = top) AS top_d, min(p.d) FILTER (p.d > trough AND p.close >= top) AS back FROM w JOIN p USING (ticker) GROUP BY ALL)
    SELECT ticker, round(dd, 6) AS drawdown, top_d AS peak_date, trough AS trough_date, back AS recovery_date, CAST(date_diff('day', top_d, trough) AS INT) AS days_down, CAST(date_diff('day', trough, back) AS INT) AS days_up FROM f""")  # fmt: skip
def drawdown_recovery(t: Tables) -> DataFrame:
    """WN-16: the deepest fall, from peak to trough to recovery, with days."""
    return m.drawdown_recovery(panel(t))


@query("SELECT o_custkey, year(o_orderdate) AS yr, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) = 1")
def best_source(t: Tables) -> DataFrame:
    """AG-07: per key and year the source of the highest priority, then the one with most."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    x = t.orders.select("o_custkey", F.year("o_orderdate").cast("long").alias("yr"), F.struct(rank.alias("p"), (-F.col("o_totalprice")).alias("v"), "o_orderkey", "o_orderstatus").alias("x"))
    return x.groupBy("o_custkey", "yr").agg(F.min("x").alias("x")).select("o_custkey", "yr", "x.o_orderkey", "x.o_orderstatus")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_of_each(t: Tables) -> DataFrame:
    """AG-08: of rows that repeat a key the last is kept."""
    return t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("SELECT event_id, user_id, event_type, row_number() OVER w AS rank_in_key, count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS n, row_number() OVER w > 1 AS quarantined FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id)")
def duplicate_quarantine(t: Tables) -> DataFrame:
    """AG-09: rows of a repeated key are numbered; all but the first go to quarantine."""
    key = Window.partitionBy("user_id", "event_type", F.to_date("ts"))
    n = F.row_number().over(key.orderBy("event_id"))
    return t.events.select("event_id", "user_id", "event_type", n.cast("long").alias("rank_in_key"), F.count("*").over(key).alias("n"), (n > 1).alias("quarantined"))


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY abs(s_acctbal) DESC, s_suppkey) AS place FROM supplier WHERE s_acctbal IS NOT NULL ORDER BY place LIMIT 20")
def largest_moves(t: Tables) -> DataFrame:
    """ST-05: the twenty largest by absolute value."""
    top = t.supplier.where("s_acctbal is not null").select("s_suppkey", "s_acctbal").orderBy(F.desc(F.abs("s_acctbal")), "s_suppkey").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("s_acctbal")), "s_suppkey")).cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 3 END AS rank FROM orders ORDER BY rank, o_orderkey LIMIT 50")
def priority_queue(t: Tables) -> DataFrame:
    """ST-06: ordered by a rank computed from priority and state."""
    urgent, open_ = F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderstatus") == "O"
    rank = F.when(urgent & open_, 0).when(open_, 1).when(urgent, 2).otherwise(3)
    return t.orders.select("o_orderkey", rank.alias("rank")).orderBy("rank", "o_orderkey").limit(50)


@query("""WITH task AS (SELECT o_orderkey AS task, 'weld P' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' to frame ' || o_orderkey % 7 END AS name FROM orders), part_id AS (SELECT p_partkey, 'P' || p_partkey AS id FROM part)
    SELECT task, name, (SELECT min(p_partkey) FROM part_id WHERE contains(name, id)) AS p_partkey FROM task""")
def substring_links(t: Tables) -> DataFrame:
    """JN-13: the first part whose id occurs in a task's name; names are cut into substrings of the ids' lengths, which join by equality."""
    k = F.col("o_orderkey")
    tasks = t.orders.select(k.alias("task"), F.concat(F.lit("weld P"), F.col("o_custkey").cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" to frame "), (k % 7).cast("string")))).alias("name"))
    return m.contained(tasks, "task", "name", t.part.select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id")), "p_partkey", "id")


_EDGE = "edge AS (SELECT p_partkey AS task, p_partkey - 1 AS pred FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 7 = 3 AND p_partkey % 2 = 0)"


@query(f"WITH RECURSIVE {_EDGE}, reach(a, b) AS (SELECT task, pred FROM edge UNION SELECT r.a, e.pred FROM reach r JOIN edge e ON e.task = r.b) SELECT a AS task FROM reach WHERE a = b")
def dependency_cycles(t: Tables) -> DataFrame:
    """REC-06: tasks that depend on themselves through others."""
    p = F.col("p_partkey")
    edges = t.part.where(p % 7 != 0).select(p.alias("task"), (p - 1).alias("pred")).unionByName(t.part.where((p % 7 == 3) & (p % 2 == 0)).select(p.alias("task"), (p + 2).alias("pred")))
    return m.on_cycles(edges)
