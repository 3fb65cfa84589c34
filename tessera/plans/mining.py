"""Terms mined from part names, and thresholds and parameters chosen on weekly orders of each market segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import calibrate, clusters, margins, terms
from tessera.plans.registry import Tables, query
from tessera.plans.restore import first_sentence
from tessera.sources.shared import work_folder


@query("""
    SELECT upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) AS short, lower(p_name) AS long, count(*) AS n
    FROM part WHERE len(string_split(p_name, ' ')) BETWEEN 2 AND 10 GROUP BY ALL""")
def abbreviation_pairs(t: Tables) -> DataFrame:
    """TX-33: part names with their initials in brackets, aligned again."""
    initials = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), ""))
    return terms.abbreviations(t.part.select(F.concat(F.lit("part: "), F.col("p_name"), F.lit(" ("), initials, F.lit("), kept")).alias("text")), "text")


def _g(o: str, e: str) -> str:
    return f"CASE WHEN {o} > 0 THEN ({o}) * ln(CAST({o} AS DOUBLE) / ({e})) ELSE 0 END"


@query(f"""
    WITH held AS (SELECT row_number() OVER () AS row, list_distinct(regexp_extract_all(lower(trim(regexp_extract(text, '^[^.!?\n]*'))), '[a-zà-öø-ÿ]+')) AS terms FROM conversations),
    spread AS (SELECT row, unnest(terms) AS term FROM held),
    counts AS (SELECT term, count(*) AS c FROM spread GROUP BY term),
    total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM held),
    pair AS (SELECT x.term AS a, y.term AS b, count(*) AS n_both FROM spread AS x JOIN spread AS y ON x.row = y.row AND x.term < y.term GROUP BY ALL HAVING count(*) >= 2),
    scored AS (
        SELECT a, b, n_both, x.c AS n_a, y.c AS n_b,
               2 * ({_g("n_both", "x.c * y.c / n")} + {_g("x.c - n_both", "x.c * (n - y.c) / n")} + {_g("y.c - n_both", "(n - x.c) * y.c / n")} + {_g("n - x.c - y.c + n_both", "(n - x.c) * (n - y.c) / n")}) AS score
        FROM pair JOIN counts AS x ON a = x.term JOIN counts AS y ON b = y.term, total WHERE n_both * n > x.c * y.c)
    SELECT * FROM scored WHERE score >= 10.83""")
def term_association(t: Tables) -> DataFrame:
    """TX-33: words of the first sentences of all turns that stand together oftener than by chance."""
    words = F.regexp_extract_all(F.lower(first_sentence(F.col("text"))), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    return terms.associated(t.conversations, words)


_GRID = [-0.5, 0.0, 0.5, 1.0, 1.5]
_Z = "CASE WHEN count({0}) OVER w >= 8 THEN ({0} - avg({0}) OVER w) / nullif(stddev_samp({0}) OVER w, 0) END"
_WEEKS = f"""
    week AS (
        SELECT c_mktsegment AS segment, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS f,
               CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS DOUBLE) AS u
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    zed AS (SELECT *, {_Z.format("n")} AS zn, {_Z.format("f")} AS zf, {_Z.format("u")} AS zu FROM week WINDOW w AS (PARTITION BY segment ORDER BY week ROWS 25 PRECEDING)),
    truth AS (
        SELECT *, coalesce(avg(n) OVER c > avg(n) OVER w, false) AS truth, lead(n) OVER o - n AS next, row_number() OVER o AS k
        FROM zed WINDOW o AS (PARTITION BY segment ORDER BY week), c AS (PARTITION BY segment ORDER BY week ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), w AS (PARTITION BY segment ORDER BY week ROWS 25 PRECEDING))"""


def _weeks(t: Tables) -> DataFrame:
    """segment, week, counts of orders, three z-scores, truth (five weeks around above the mean of the last 26), change to the next week."""
    amount = lambda c: F.sum(c.cast("double"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"))
    weeks = rows.agg(F.count("*").cast("double").alias("n"), amount((F.col("o_orderstatus") == "F").cast("int")).alias("f"), amount(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")).alias("u"))
    along = Window.partitionBy("segment").orderBy("week")
    return (
        weeks.withColumns({f"z{c}": calibrate.rolling_z(c, "segment", "week", 26, 8) for c in "nfu"})
        .withColumn("truth", F.coalesce(F.avg("n").over(along.rowsBetween(-2, 2)) > F.avg("n").over(along.rowsBetween(-25, 0)), F.lit(False)))
        .withColumn("next", F.lead("n").over(along) - F.col("n")).withColumn("score", F.col("zn") + F.col("zu"))
    )


@query(f"""
    WITH {_WEEKS},
    numbered AS (SELECT *, CASE WHEN truth THEN sum(CASE WHEN truth AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY k ROWS UNBOUNDED PRECEDING) END AS event
                 FROM (SELECT *, lag(truth) OVER (PARTITION BY segment ORDER BY k) AS prev FROM truth)),
    -- every event left out in turn, every threshold tried on what is left, all counted anew
    run AS (SELECT DISTINCT segment, event AS out FROM numbered WHERE event IS NOT NULL),
    trial AS (SELECT segment, out, i, [{", ".join(map(str, _GRID))}][i] AS threshold FROM run, range(1, {len(_GRID) + 1}) AS u(i)),
    near AS (
        SELECT r.segment, r.out, d.k, bool_or(x.event IS NOT NULL AND x.event <> r.out) AS near
        FROM run AS r JOIN numbered AS d USING (segment) JOIN numbered AS x ON x.segment = d.segment AND x.k BETWEEN d.k - 3 AND d.k + 3 GROUP BY ALL),
    counted AS (
        SELECT segment, out, i, threshold, avg(CASE WHEN event <> out THEN s END) AS recall, avg(CASE WHEN NOT near THEN s END) AS alarms, avg(CASE WHEN event = out THEN s END) AS own, count(*) FILTER (event = out) AS days
        FROM (SELECT t.*, d.event, n.near, CAST(coalesce(d.zn + d.zu > t.threshold, false) AS INT) AS s FROM trial AS t JOIN numbered AS d USING (segment) JOIN near AS n USING (segment, out, k)) GROUP BY ALL),
    best AS (SELECT *, recall - 2 * coalesce(alarms, 0) AS objective, row_number() OVER (PARTITION BY segment, out ORDER BY recall - 2 * coalesce(alarms, 0) DESC NULLS LAST, i) AS r FROM counted)
    SELECT segment, CAST(out AS BIGINT) AS event, days, CAST(threshold AS DOUBLE) AS threshold, objective, own AS recall FROM best WHERE r = 1""")
def event_calibration(t: Tables) -> DataFrame:
    """CTL-06: the threshold that all other events choose, for each event."""
    return calibrate.leave_one_event_out(_weeks(t), "segment", "week", "truth", "score", _GRID)


@query(f"""
    WITH {_WEEKS},
    mean AS (
        SELECT segment, avg(CASE WHEN list_avg(list_filter([zn, zf, zu], lambda x: x IS NOT NULL)) > 0.5 THEN 1.0 ELSE 0.0 END) AS all3,
               avg(CASE WHEN list_avg(list_filter([zf, zu], lambda x: x IS NOT NULL)) > 0.5 THEN 1.0 ELSE 0.0 END) AS zn,
               avg(CASE WHEN list_avg(list_filter([zn, zu], lambda x: x IS NOT NULL)) > 0.5 THEN 1.0 ELSE 0.0 END) AS zf,
               avg(CASE WHEN list_avg(list_filter([zn, zf], lambda x: x IS NOT NULL)) > 0.5 THEN 1.0 ELSE 0.0 END) AS zu
        FROM truth WHERE truth GROUP BY segment)
    SELECT segment, ['zn', 'zf', 'zu'][i] AS factor, all3 - [zn, zf, zu][i] AS loss FROM mean, range(1, 4) AS u(i)""")
def factor_ablation(t: Tables) -> DataFrame:
    """CTL-06: what recall loses without each factor."""
    return calibrate.ablation(_weeks(t), "segment", "truth", ["zn", "zf", "zu"], 0.5)


_SMOOTH, _SCHEMES = [1, 2, 4, 8], {"equal": [1, 1, 1], "count": [1, 0, 0], "late": [0, -1, 1]}


@query(f"""
    WITH {_WEEKS},
    smooth AS ({" UNION ALL ".join(f"SELECT segment, next, {s} AS smoothing, avg(zn) OVER w AS a, avg(zf) OVER w AS b, avg(zu) OVER w AS c FROM truth WINDOW w AS (PARTITION BY segment ORDER BY k ROWS {s - 1} PRECEDING)" for s in _SMOOTH)}),
    tried AS ({" UNION ALL ".join(f"SELECT segment, smoothing, '{n}' AS scheme, {j} AS j, next, ({w[0]}) * a + ({w[1]}) * b + ({w[2]}) * c AS score FROM smooth" for j, (n, w) in enumerate(_SCHEMES.items()))}),
    scored AS (SELECT segment, smoothing, scheme, j, count(*) AS n, corr(score, next) AS correlation FROM tried WHERE score IS NOT NULL AND next IS NOT NULL GROUP BY ALL)
    SELECT segment, smoothing, scheme, n, correlation, row_number() OVER (PARTITION BY segment ORDER BY round(correlation, 12) DESC NULLS LAST, smoothing, j) AS rank FROM scored""")
def parameter_grid(t: Tables) -> DataFrame:
    """CTL-05: smoothing and weights by correlation with the next week's change."""
    return calibrate.grid_search(_weeks(t), "segment", "week", ["zn", "zf", "zu"], "next", _SMOOTH, _SCHEMES)


@query()
def vector_clusters(t: Tables) -> DataFrame:
    """TX-53: all vectors in the number of clusters, from two to five, with the highest silhouette."""
    found, tried = clusters.best_clusters(t.embeddings, "vec_id", "embedding")
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"), F.lit(len(tried)).alias("tried"))


@query()
def margin_suggestions(t: Tables) -> DataFrame:
    """TX-54 and TX-55: learned from documents with a quality label, a suggestion for each without one, where the margin is half or more, with a calibrated probability; elsewhere a rule on length decides."""
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cells = t.documents.select("doc_id", F.size(F.split("text", " ")).alias("words"), margins.hashed_words(F.col("text")).alias("cells"))
    path = work_folder(t.spark, "suggestions")
    cells.join(labels.hint("merge"), "doc_id", "left").select("doc_id", "words", "cells", F.when(F.col("quality").isNotNull(), 2 * F.col("quality") - 1).alias("label")).write.option("compression", "zstd").parquet(path)  # read three times
    rows = t.spark.read.parquet(path)
    known = rows.where("label is not null").select("cells", "label")
    weights = margins.train_margins(known)
    steps = margins.calibrate(margins.score_margins(known, weights))
    open_rows = margins.score_margins(rows.where("label is null").drop("label"), weights)
    sure = F.abs("margin") >= 0.5
    by_rule = F.when(F.col("words") >= 50, 1).otherwise(0)
    return open_rows.select("doc_id", F.round("margin", 6).alias("margin"), F.round(margins.probability(F.col("margin"), steps), 6).alias("probability"), F.when(sure, (F.col("margin") > 0).cast("int")).otherwise(by_rule).alias("suggested"), F.when(sure, "model").otherwise("rule").alias("backend"))
