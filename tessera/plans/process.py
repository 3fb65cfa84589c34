"""Process-mining and bill-of-material queries: events by user stand for cases, part numbers for a parts tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bom, process
from tessera.plans.registry import Tables, query

LOG = 'log AS (SELECT user_id AS "case", event_type AS activity, ts, event_id AS seq FROM events)'
_W = '(PARTITION BY "case" ORDER BY ts, seq)'


def log(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("case"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_DFG = f"""WITH {LOG}, s AS (SELECT activity AS source, lead(activity) OVER {_W} AS target, epoch_us(lead(ts) OVER {_W}) / 1e6 - epoch_us(ts) / 1e6 AS wait FROM log)
    SELECT source, target, count(*) AS n, round(avg(wait), 3) AS mean_wait FROM s WHERE target IS NOT NULL GROUP BY 1, 2"""


@query(_DFG)
def directly_follows(t: Tables) -> DataFrame:
    """PMN-01 and PMN-02"""
    return process.directly_follows(log(t)).withColumn("mean_wait", F.round("mean_wait", 3))


@query(f"""WITH {LOG}, x AS (SELECT activity, row_number() OVER {_W} = 1 AS f, lead(activity) OVER {_W} IS NULL AS l FROM log)
    SELECT activity, count(*) FILTER (f) AS starts, count(*) FILTER (l) AS finishes FROM x GROUP BY 1 HAVING count(*) FILTER (f OR l) > 0""")  # fmt: skip
def start_end_activities(t: Tables) -> DataFrame:
    """PMN-03"""
    return process.ends(log(t))


@query(f'WITH {LOG} SELECT "case", count(*) AS events, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM log GROUP BY 1')
def case_durations(t: Tables) -> DataFrame:
    """PMN-04"""
    return process.durations(log(t)).withColumn("seconds", F.round("seconds", 3))


@query(f"{_DFG} ORDER BY avg(wait) DESC, source, target LIMIT 3")
def bottlenecks(t: Tables) -> DataFrame:
    """PMN-05"""
    return process.directly_follows(log(t)).orderBy(F.desc("mean_wait"), "source", "target").limit(3).withColumn("mean_wait", F.round("mean_wait", 3))


@query(f"""WITH {LOG}, x AS (SELECT "case", activity, lag(activity) OVER {_W} = activity AS again FROM log), c AS (SELECT "case", activity, count(*) FILTER (again) AS loops, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT activity, CAST(sum(loops) AS BIGINT) AS self_loops, count(*) FILTER (n > 1) AS revisits FROM c GROUP BY 1""")  # fmt: skip
def rework(t: Tables) -> DataFrame:
    """PMN-06 and PMN-10"""
    return process.rework(log(t))


_EXPECTED = ["signup", "view", "click", "purchase"]


@query(f"""WITH {LOG}, p AS (SELECT "case", ts, seq, list_position(['signup', 'view', 'click', 'purchase'], activity) AS place FROM log), q AS (SELECT "case", lead(place) OVER {_W} - place AS jump FROM p WHERE place > 0)
    SELECT "case", count(*) FILTER (jump < 0) AS backward, count(*) FILTER (jump > 1) AS skips FROM q GROUP BY 1""")  # fmt: skip
def conformance(t: Tables) -> DataFrame:
    """PMN-07"""
    return process.conformance(log(t), _EXPECTED)


@query(f"""WITH {LOG}, c AS (SELECT "case", max(CAST(activity = 'signup' AS INT)) AS s, max(CAST(activity = 'purchase' AS INT)) AS p, count(*) FILTER (activity = 'error') AS e FROM log GROUP BY 1)
    SELECT "case", CASE WHEN s = 1 AND p = 1 AND e = 0 THEN 'CONFORM' WHEN p = 0 THEN 'NO_DELIVERY' WHEN s = 0 THEN 'MISSING_COMMITMENT' WHEN e > 15 THEN 'EXTRA_LOOP' ELSE 'PARTIAL' END AS verdict FROM c""")  # fmt: skip
def flow_verdicts(t: Tables) -> DataFrame:
    """PMN-08 and AG-41"""
    has = lambda a: F.bool_or(F.col("activity") == a)
    c = log(t).groupBy("case").agg(has("signup").alias("s"), has("purchase").alias("p"), F.count_if(F.col("activity") == "error").alias("e"))
    return c.select("case", F.when(F.col("s") & F.col("p") & (F.col("e") == 0), "CONFORM").when(~F.col("p"), "NO_DELIVERY").when(~F.col("s"), "MISSING_COMMITMENT").when(F.col("e") > 15, "EXTRA_LOOP").otherwise("PARTIAL").alias("verdict"))


_DAILY = f"""{LOG}, daily AS (SELECT "case" * 100 + day(ts) AS "case", activity, ts, seq FROM log)"""


def _daily(t: Tables) -> DataFrame:
    return log(t).withColumn("case", F.col("case") * 100 + F.dayofmonth("ts"))


@query(f"""WITH {_DAILY}, v AS (SELECT "case", string_agg(activity, '>' ORDER BY ts, seq) AS variant FROM daily GROUP BY 1)
    SELECT variant, count(*) AS n, min("case") AS first_case FROM v GROUP BY 1 ORDER BY n DESC, variant LIMIT 20""")  # fmt: skip
def variants(t: Tables) -> DataFrame:
    """PMN-09 and ST-03"""
    return process.variants(_daily(t)).orderBy(F.desc("n"), "variant").limit(20)


@query(f"""WITH {_DAILY}, v AS (SELECT "case", string_agg(activity, '>' ORDER BY ts, seq) AS variant FROM daily GROUP BY 1),
    top AS (SELECT variant FROM v GROUP BY 1 ORDER BY count(*) DESC, variant LIMIT 5) SELECT d."case", d.activity, d.seq FROM daily d JOIN v USING ("case") JOIN top USING (variant)""")  # fmt: skip
def top_variant_events(t: Tables) -> DataFrame:
    """ST-07: all events of the cases of the five commonest variants."""
    d = _daily(t)
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "activity"))), lambda e: e["activity"]), ">")
    by_case = d.groupBy("case").agg(trace.alias("variant"))
    top = by_case.groupBy("variant").count().orderBy(F.desc("count"), "variant").limit(5).select("variant")
    return d.join(by_case.join(F.broadcast(top), "variant", "left_semi"), "case", "left_semi").select("case", "activity", "seq")


@query(f"""WITH {LOG}, r AS (SELECT "case", ts, seq FROM log WHERE activity = 'view') SELECT r."case", r.seq FROM r
    WHERE NOT EXISTS (SELECT 1 FROM log p WHERE p."case" = r."case" AND p.activity = 'purchase' AND p.ts > r.ts AND p.ts <= r.ts + INTERVAL 1 DAY)""")  # fmt: skip
def sla_breaches(t: Tables) -> DataFrame:
    """PMN-11, and the first of PMN-12: views without a purchase within a day."""
    upcoming = Window.partitionBy("case").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # a running minimum from the end
    x = log(t).withColumn("bought", F.min(F.when(F.col("activity") == "purchase", F.col("ts"))).over(upcoming))
    late = F.col("bought").isNull() | (F.col("bought") > F.col("ts") + F.expr("interval 1 day"))
    return x.where((F.col("activity") == "view") & late).select("case", "seq")


@query(f"""WITH {_DAILY}, o AS (SELECT DISTINCT "case", activity FROM daily) SELECT a.activity AS a, b.activity AS b, count(*) AS cases FROM o a JOIN o b ON a."case" = b."case" AND a.activity < b.activity GROUP BY 1, 2""")
def co_occurrence(t: Tables) -> DataFrame:
    """PMN-13 and JN-08"""
    return process.co_occurrence(_daily(t))


@query(f"""WITH {LOG}, x AS (SELECT "case", activity, seq, lag(activity) OVER {_W} AS b FROM log) SELECT "case", activity, seq FROM x WHERE b IS NULL OR b <> activity""")
def collapsed_repeats(t: Tables) -> DataFrame:
    """WN-48"""
    return process.without_adjacent_repeats(log(t)).select("case", "activity", "seq")


@query(f"""WITH {LOG} SELECT a."case", a.seq, round(epoch_us(min(b.ts)) / 1e6 - epoch_us(min(a.ts)) / 1e6, 3) AS latency FROM log a JOIN log b ON a."case" = b."case" AND b.ts > a.ts AND b.activity <> 'error' WHERE a.activity = 'error' GROUP BY 1, 2""")
def response_latency(t: Tables) -> DataFrame:
    """JN-11: from each error to the user's next other event, by a frame that looks ahead instead of a range join."""
    upcoming = Window.partitionBy("case").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # a running minimum from the end
    x = log(t).withColumn("answer", F.min(F.when(F.col("activity") != "error", F.col("ts"))).over(upcoming))
    return x.where("activity = 'error' and answer is not null").select("case", "seq", F.round(F.unix_micros("answer") / 1e6 - F.unix_micros("ts") / 1e6, 3).alias("latency"))


EDGES = "edges AS (SELECT p_partkey // 2 AS parent, p_partkey AS child, CAST(1 + p_size % 4 AS DOUBLE) AS qty FROM part WHERE p_partkey > 1)"


def edges(t: Tables) -> DataFrame:
    return t.part.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child"), (1 + F.col("p_size") % 4).cast("double").alias("qty"))


def _tops(t: Tables) -> DataFrame:
    """Every assembly, not only those that nothing contains."""
    return edges(t).select(F.col("parent").alias("top")).distinct()


_TREE = f"""WITH RECURSIVE {EDGES}, tree AS (SELECT DISTINCT parent AS top, parent AS item, 0 AS level, CAST(1 AS DOUBLE) AS qty FROM edges
    UNION ALL SELECT t.top, e.child, t.level + 1, t.qty * e.qty FROM tree t JOIN edges e ON e.parent = t.item)"""


@query(f"{_TREE} SELECT top, item, level, qty, false AS cycle FROM tree WHERE level > 0")
def bom_explosion(t: Tables) -> DataFrame:
    """REC-01 of every assembly"""
    return bom.explode(edges(t), _tops(t))


@query(f"{_TREE} SELECT top, round(sum(qty * p_retailprice), 2) AS cost FROM tree JOIN part ON p_partkey = item WHERE level > 0 AND item NOT IN (SELECT parent FROM edges) GROUP BY 1")
def bom_cost(t: Tables) -> DataFrame:
    """REC-02 of every assembly: the subtotals of all sub-assemblies"""
    costs = t.part.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("cost"))
    return bom.roll_up_cost(bom.explode(edges(t), _tops(t)), costs, edges(t)).withColumn("cost", F.round("cost", 2))


@query(f"""WITH RECURSIVE {EDGES}, up AS (SELECT p_partkey AS item, p_partkey AS used_in, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT parent FROM edges) UNION ALL SELECT u.item, e.parent, u.level + 1 FROM up u JOIN edges e ON e.child = u.used_in)
    SELECT item, used_in, min(level) AS level FROM up WHERE level > 0 GROUP BY 1, 2""")  # fmt: skip
def bom_where_used(t: Tables) -> DataFrame:
    """REC-03 of every bought part: what has no parts of its own"""
    bought = t.part.select(F.col("p_partkey").alias("item")).join(edges(t).select(F.col("parent").alias("item")).hint("merge"), "item", "left_anti")
    return bom.where_used(edges(t), bought)


@query(f"""{_TREE}, x AS (SELECT top, item, p_type, p_size + level AS lead FROM tree JOIN part ON p_partkey = item WHERE level > 0), best AS (SELECT top, max(lead) AS lead_time FROM x GROUP BY 1)
    SELECT top, count(*) FILTER (p_type <> 'PROMO') AS compliant, count(*) FILTER (p_type = 'PROMO') AS not_compliant, max(lead) AS lead_time, min(item) FILTER (lead = lead_time) AS critical FROM x JOIN best USING (top) GROUP BY 1""")  # fmt: skip
def bom_compliance(t: Tables) -> DataFrame:
    """REC-04 of every assembly: compliance counts and the item with the longest lead time."""
    return _compliance(t, _tops(t))


_WHOLE_TREE = f"""WITH RECURSIVE {EDGES}, tree AS (SELECT DISTINCT parent AS top, parent AS item, 0 AS level, CAST(1 AS DOUBLE) AS qty FROM edges WHERE parent NOT IN (SELECT child FROM edges)
    UNION ALL SELECT t.top, e.child, t.level + 1, t.qty * e.qty FROM tree t JOIN edges e ON e.parent = t.item)"""


def _compliance(t: Tables, tops: DataFrame) -> DataFrame:
    x = bom.explode(edges(t), tops).join(t.part.select(F.col("p_partkey").alias("item"), "p_type", "p_size").hint("merge"), "item").withColumn("lead", F.col("p_size") + F.col("level"))
    return x.groupBy("top").agg(F.count_if(F.col("p_type") != "PROMO").alias("compliant"), F.count_if(F.col("p_type") == "PROMO").alias("not_compliant"), F.max("lead").alias("lead_time"), F.max_by("item", F.struct("lead", -F.col("item"))).alias("critical"))


@query(f"{_WHOLE_TREE} SELECT top, item, level, qty, false AS cycle FROM tree WHERE level > 0")
def bom_explosion_whole(t: Tables) -> DataFrame:
    """REC-01 from every root"""
    return bom.explode(edges(t), bom.roots(edges(t)))


@query(f"{_WHOLE_TREE} SELECT top, round(sum(qty * p_retailprice), 2) AS cost FROM tree JOIN part ON p_partkey = item WHERE level > 0 AND item NOT IN (SELECT parent FROM edges) GROUP BY 1")
def bom_cost_whole(t: Tables) -> DataFrame:
    """REC-02 from every root"""
    costs = t.part.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("cost"))
    return bom.roll_up_cost(bom.explode(edges(t), bom.roots(edges(t))), costs, edges(t)).withColumn("cost", F.round("cost", 2))


@query(f"""{_WHOLE_TREE}, x AS (SELECT top, item, p_type, p_size + level AS lead FROM tree JOIN part ON p_partkey = item WHERE level > 0), best AS (SELECT top, max(lead) AS lead_time FROM x GROUP BY 1)
    SELECT top, count(*) FILTER (p_type <> 'PROMO') AS compliant, count(*) FILTER (p_type = 'PROMO') AS not_compliant, max(lead) AS lead_time, min(item) FILTER (lead = lead_time) AS critical FROM x JOIN best USING (top) GROUP BY 1""")  # fmt: skip
def bom_compliance_whole(t: Tables) -> DataFrame:
    """REC-04 from every root; of items with the longest lead time the smallest is critical."""
    return _compliance(t, bom.roots(edges(t)))


@query(f"""WITH RECURSIVE {EDGES}, up AS (SELECT p_partkey AS item, p_partkey AS used_in, 0 AS level FROM part UNION ALL SELECT u.item, e.parent, u.level + 1 FROM up u JOIN edges e ON e.child = u.used_in)
    SELECT item, used_in, min(level) AS level FROM up WHERE level > 0 GROUP BY 1, 2""")  # fmt: skip
def bom_where_used_whole(t: Tables) -> DataFrame:
    """REC-03 from every part"""
    return bom.where_used(edges(t), t.part.select(F.col("p_partkey").alias("item")))


@query(f"""WITH {EDGES}, bad AS (SELECT 'orphan_parent' AS rule, child AS item FROM edges WHERE parent NOT IN (SELECT child FROM edges) AND parent <> 1
    UNION ALL SELECT 'single_source', p_partkey FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT 'quantity', child FROM edges WHERE qty > 3) SELECT rule, item FROM bad""")  # fmt: skip
def bom_validation(t: Tables) -> DataFrame:
    """REC-05"""
    e = edges(t)
    orphans = e.where("parent <> 1").join(e.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.lit("orphan_parent").alias("rule"), F.col("child").alias("item"))
    single = t.part.where("p_brand = 'Brand#1'").select(F.lit("single_source").alias("rule"), F.col("p_partkey").alias("item"))
    return orphans.unionByName(single).unionByName(e.where("qty > 3").select(F.lit("quantity").alias("rule"), F.col("child").alias("item")))
