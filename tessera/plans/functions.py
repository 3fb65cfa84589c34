"""Queries that apply the scalar functions to whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric, text
from tessera.operators import ranks
from tessera.plans.registry import Tables, query


@query("SELECT p_partkey, CAST(p_partkey * 1234567 AS DOUBLE) AS v FROM part")
def parse_numbers(t: Tables) -> DataFrame:
    """FN-02: numbers written with thousands commas come back."""
    return t.part.select("p_partkey", numeric.parse_number(F.format_number(F.col("p_partkey") * 1234567, 0)).alias("v"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN CAST(p_size AS DOUBLE) * 10 ELSE CAST(p_size AS DOUBLE) END AS v FROM part")
def clean_ocr(t: Tables) -> DataFrame:
    """FN-03"""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    raw = F.when(k == 0, "N/A").when(k == 1, F.concat(F.lit("("), s, F.lit(")"))).when(k == 2, F.concat(s, F.lit("%"))).when(k == 3, F.concat(s, F.lit("O"))).otherwise(F.concat(F.lit(" "), s))
    return t.part.select("p_partkey", numeric.clean_ocr_number(raw).alias("v"))


@query("SELECT p_partkey, p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1000.0 END AS v, floor(round_even(p_retailprice / 7, 2) * 100) / 100 AS f FROM part")
def units_and_rounding(t: Tables) -> DataFrame:
    """FN-04 and FN-05: an unknown unit gives null."""
    unit = F.when(F.col("p_partkey") % 3 == 0, "thousand").when(F.col("p_partkey") % 3 == 1, "billion").otherwise("furlong")
    return t.part.select("p_partkey", numeric.to_million(F.col("p_retailprice"), unit).alias("v"), numeric.round_then_floor(F.col("p_retailprice") / 7, 2).alias("f"))


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1000 THEN 0.001 WHEN abs(o_totalprice) >= 100 THEN 0.005 ELSE 0.01 END AS tolerance, round(greatest(0.0, least(1.0, 0.7 - 0.1 * (o_orderkey % 9) + 0.05 * (o_orderkey % 4))), 3) AS confidence FROM orders")
def tolerance_and_confidence(t: Tables) -> DataFrame:
    """FN-06 and FN-09"""
    from tessera.operators.reconcile import tolerance_for

    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", tolerance_for(F.col("o_totalprice")).cast("double").alias("tolerance"), numeric.confidence(F.lit(0.7), k % 9, k % 4).alias("confidence"))


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS revenue, p_retailprice * 0.6 AS cogs, p_retailprice * CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 0.4 END AS gp, p_retailprice * 0.1 AS opex, p_retailprice * CASE WHEN p_partkey % 6 = 0 THEN 0.2 ELSE 0.3 END AS oi FROM part)
    SELECT p_partkey, list_filter([CASE WHEN abs(revenue - cogs - gp) > greatest(1.0, 0.01 * gp) THEN 'gross_profit' END, CASE WHEN abs(gp - opex - oi) > greatest(1.0, 0.01 * oi) THEN 'operating_income' END], lambda v: v IS NOT NULL) AS failed FROM x""")  # fmt: skip
def accounting_identities(t: Tables) -> DataFrame:
    """FN-10 and AG-10"""
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    none = F.lit(None).cast("double")
    d = {"revenue": p, "cogs": p * 0.6, "gross_profit": p * F.when(k % 4 == 0, 0.5).otherwise(0.4), "opex": p * 0.1, "operating_income": p * F.when(k % 6 == 0, 0.2).otherwise(0.3)} | dict.fromkeys(("pretax", "tax", "net_income", "liabilities", "equity", "assets"), none)
    return t.part.select("p_partkey", numeric.failed_checks(d).alias("failed"))


@query("SELECT p_partkey, round(p_retailprice - 60, 4) AS unit, round(1000 / (p_retailprice - 60), 6) AS breakeven, round((p_retailprice - 60) * 50 / ((p_retailprice - 60) * 50 - 1000), 6) AS leverage, round((p_size * 30.0 / p_retailprice - 1) * 100, 2) AS upside, CASE WHEN p_size >= 10 THEN round(p_retailprice / p_size, 6) END AS per FROM part")
def cost_and_valuation(t: Tables) -> DataFrame:
    """FN-12; ``valuation`` and ``calibration`` do the rest"""
    p = F.col("p_retailprice")
    c = numeric.cost_structure(F.lit(60.0), F.lit(1000.0), p, F.lit(50.0))
    eps = F.when(F.col("p_size") >= 10, F.col("p_size").cast("double")).otherwise(0.0)
    return t.part.select("p_partkey", F.round(c["unit_contribution"], 4).alias("unit"), F.round(c["breakeven_units"], 6).alias("breakeven"), F.round(c["operating_leverage"], 6).alias("leverage"), numeric.upside(F.col("p_size") * 30.0, p).alias("upside"), F.round(numeric.price_earnings(p, eps), 6).alias("per"))


@query("""SELECT doc_id, printf('%dh %02dm %02ds', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) AS d, CASE WHEN n_chars >= 1024 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) ELSE printf('%d B', n_chars) END AS s FROM documents""")
def readable(t: Tables) -> DataFrame:
    """FN-19"""
    return t.documents.select("doc_id", numeric.duration_text(F.col("n_chars")).alias("d"), numeric.size_text(F.col("n_chars")).alias("s"))


@query("SELECT event_id, CASE WHEN value / 50 >= 0.9 THEN 'A' WHEN value / 50 >= 0.75 THEN 'B' WHEN value / 50 >= 0.5 THEN 'C' ELSE 'D' END AS grade, CASE WHEN event_id % 2 = 0 AND least(value / 50, 0.8) >= 0.85 OR event_id % 2 = 1 AND value / 50 >= 0.85 THEN 'auto' WHEN value / 50 >= 0.5 THEN 'review' ELSE 'reject' END AS gate FROM events")
def grades_and_gates(t: Tables) -> DataFrame:
    """FN-21 and TX-12"""
    c = F.col("value") / 50
    return t.events.select("event_id", numeric.grade(c).alias("grade"), text.gate(c, F.col("event_id") % 2 == 0).alias("gate"))


@query("SELECT p_partkey, p_name AS half, lower(p_name) AS subject FROM part")
def width_and_subject(t: Tables) -> DataFrame:
    """TX-04, TX-06 and TX-17: full-width letters and reply marks undone."""
    wide = F.translate("p_name", text.NARROW, text.WIDE)
    return t.part.select("p_partkey", text.half_width(wide).alias("half"), text.subject_key(F.concat(F.lit("RE: Fwd：[x] "), F.regexp_replace("p_name", " ", "  "))).alias("subject"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS script FROM documents")
def script_decision(t: Tables) -> DataFrame:
    """TX-03"""
    return t.documents.select("doc_id", text.script_share(F.col("text")).alias("script"))


@query("SELECT doc_id, lower(CASE WHEN regexp_extract(text, '([a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_.-]+)', 1) <> '' THEN regexp_extract(text, '([a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_.-]+)', 1) END) AS mail FROM documents WHERE contains(text, '@')")
def mail_addresses(t: Tables) -> DataFrame:
    """TX-19"""
    found = text.address(F.col("text"))
    return t.documents.where(F.contains("text", F.lit("@"))).select("doc_id", F.when(F.regexp_extract("text", r"([\w.+-]+@[\w-]+\.[\w.-]+)", 1) != "", found).alias("mail"))


@query("SELECT doc_id, len(string_split_regex(text, '\\n')) AS n_lines, len(regexp_extract_all(text, '\\d{4}-\\d{2}-\\d{2}')) AS n_dates, regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '[0-9]{7,}', '<NUMBER>', 'g') AS masked FROM documents")
def entities_and_masks(t: Tables) -> DataFrame:
    """TX-10 and TX-49"""
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size(text.entities(F.col("text"))["date"]).cast("long").alias("n_dates"), text.mask(F.col("text")).alias("masked"))


@query("""WITH s AS (SELECT item_id, unnest(string_split_regex(text, '[.!?\\n]')) AS s FROM benchmark) SELECT item_id, count(*) AS n FROM s WHERE trim(s) <> '' GROUP BY 1""")
def sentence_counts(t: Tables) -> DataFrame:
    """TX-50: sentences as rows."""
    return t.benchmark.select("item_id", F.explode(text.sentences(F.col("text"))).alias("s")).groupBy("item_id").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard
    FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id JOIN (SELECT item_id, count(*) AS n FROM w GROUP BY 1) x ON x.item_id = a.item_id JOIN (SELECT item_id, count(*) AS n FROM w GROUP BY 1) y ON y.item_id = b.item_id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.1""")  # fmt: skip
def similar_items(t: Tables) -> DataFrame:
    """TX-30 in part: items of a Jaccard similarity of 0.1 at least. Such items share one of their rarest words, so the commonest need not meet."""
    w = t.benchmark.select("item_id", F.explode(F.array_distinct(text.word_list(F.col("text")))).alias("w"))
    rarity = w.groupBy("w").agg(F.count("*").alias("df"))
    words = w.join(rarity, "w").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    words = words.select("item_id", F.transform("s", lambda x: x["w"]).alias("s"), F.size("s").alias("n"))
    prefix = words.select("item_id", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * 0.1) + 1).cast("int"))).alias("w"))
    pairs = prefix.select(F.col("item_id").alias("a"), "w").join(prefix.select(F.col("item_id").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    x = pairs.join(words.select(F.col("item_id").alias("a"), F.col("s").alias("x")), "a").join(words.select(F.col("item_id").alias("b"), F.col("s").alias("y")), "b")
    score = text.jaccard(F.col("x"), F.col("y"))
    return x.where(score >= 0.1).select("a", "b", F.round(score, 6).alias("jaccard"))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), tf AS (SELECT item_id, w, count(*) AS c FROM w GROUP BY 1, 2), df AS (SELECT w, count(*) AS d FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT item_id) AS n FROM w)
    SELECT item_id, w, round(c * (ln((1 + n) / (1 + d)) + 1), 6) AS tfidf FROM tf JOIN df USING (w), n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(c * (ln((1 + n) / (1 + d)) + 1), 6) DESC, w) <= 5""")  # fmt: skip
def tfidf_keywords(t: Tables) -> DataFrame:
    """TX-52: the five heaviest words of each item."""
    w = t.benchmark.select("item_id", F.explode(text.word_list(F.col("text"))).alias("w"))
    tf = w.groupBy("item_id", "w").agg(F.count("*").alias("c"))
    df = tf.groupBy("w").agg(F.count("*").alias("d"))
    n = F.broadcast(w.agg(F.countDistinct("item_id").alias("n")))  # one row
    x = tf.join(df, "w").join(n).withColumn("tfidf", F.round(F.col("c") * (F.ln((1 + F.col("n")) / (1 + F.col("d"))) + 1), 6))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("tfidf"), "w"))).where("k <= 5").select("item_id", "w", "tfidf")


@query("""WITH r AS (SELECT * FROM (VALUES (1, 'topic', 'money', 'token|licen'), (2, 'topic', 'law', 'copyright|license'), (3, 'form', 'table', '[|]'), (4, 'form', 'mail', '@')) AS v(ord, dim, label, pattern))
    SELECT doc_id, dim, arg_min(label, ord) AS label FROM documents JOIN r ON regexp_matches(lower(text), pattern) GROUP BY 1, 2""")  # fmt: skip
def rule_labels(t: Tables) -> DataFrame:
    """TX-23, TX-24 and TX-28: a fixed table of rules; the first that fits in each dimension is the label."""
    low = F.lower("text")
    rules = [("topic", [("money", "token|licen"), ("law", "copyright|license")]), ("form", [("table", "[|]"), ("mail", "@")])]
    picks = []
    for dim, labels in rules:
        pick = F.lit(None).cast("string")
        for label, pattern in reversed(labels):
            pick = F.when(low.rlike(pattern), label).otherwise(pick)
        picks.append(F.struct(F.lit(dim).alias("dim"), pick.alias("label")))
    return t.documents.select("doc_id", F.inline(F.array(*picks))).where("label is not null")


@query("SELECT sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR))) AS uid, left(sha256(event_type || CAST(user_id AS VARCHAR)), 12) AS short, count(*) AS n FROM events GROUP BY event_type, user_id")
def hash_ids(t: Tables) -> DataFrame:
    """TX-14 and TX-58"""
    g = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    user = F.col("user_id").cast("string")
    return g.select(F.sha1(F.concat_ws("|", "event_type", user)).alias("uid"), F.left(F.sha2(F.concat("event_type", user), 256), F.lit(12)).alias("short"), "n")


@query("SELECT event_type, user_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS INT) AS number FROM events GROUP BY 1, 2")
def index_numbers(t: Tables) -> DataFrame:
    """TX-59: numbers per type in order of first sight."""
    g = t.events.groupBy("event_type", "user_id").agg(F.min("event_id").alias("seen"))
    return ranks.positions(g, "event_type", "seen", "user_id").select("event_type", "user_id", (F.col("place") + 1).cast("int").alias("number"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) - 1911 AS INT) AS roc, CAST(CASE isodow(o_orderdate) WHEN 5 THEN CAST(o_orderdate AS DATE) + 3 WHEN 6 THEN CAST(o_orderdate AS DATE) + 2 ELSE CAST(o_orderdate AS DATE) + 1 END AS DATE) AS usable FROM orders")
def dates(t: Tables) -> DataFrame:
    """DT-01, DT-02, DT-03 and DT-04: three notations of a day, the calendar of the republic, the next business day."""
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    d = text.parse_date(written)
    x = t.orders.select("o_orderkey", d.alias("d"))
    usable = F.date_add("d", F.when(F.weekday("d") == 4, 3).when(F.weekday("d") == 5, 2).otherwise(1))
    return x.select("o_orderkey", "d", text.roc_year(F.col("d")).alias("roc"), usable.alias("usable"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type))[1:2] AS kinds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS joined, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def arrays(t: Tables) -> DataFrame:
    """AR-01, AR-02 and JS-02"""
    kinds = F.sort_array(F.collect_set("event_type"))
    return t.events.groupBy("user_id").agg(F.slice(kinds, 1, 2).alias("kinds"), F.array_join(kinds, ",").alias("joined"), F.size(kinds).cast("long").alias("n"))


@query("SELECT o_orderkey, key, value FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS key, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders)")
def melt(t: Tables) -> DataFrame:
    """SNK-14 and SRC-18: wide to long."""
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).unpivot("o_orderkey", ["status", "priority"], "key", "value")
