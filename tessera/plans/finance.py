"""Statements, labels, periods and gates. Orders stand in for filed facts: a customer is a company, a year of orders a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import finance as fin
from tessera.plans.registry import Tables, query

# A statement of 12 lines per customer and year; some lines are missing, some are off.
STATEMENT = """
    base AS (
        SELECT o_custkey AS company, CAST(year(o_orderdate) AS BIGINT) AS yr, sum(o_totalprice) AS rev, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2),
    st AS (
        SELECT company, yr, rev AS revenue, rev * 0.6 AS cogs, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN rev * 0.5 ELSE rev * 0.4 END AS gross_profit,
               rev * 0.1 AS opex, CASE WHEN n % 3 = 0 THEN NULL ELSE rev * 0.3 END AS operating_income, rev * 0.28 AS pretax, rev * 0.05 AS tax, rev * 0.23 AS net_income,
               rev * 2 AS assets, rev * 1.2 AS liabilities, rev * CASE WHEN company % 9 = 0 THEN 0.5 ELSE 0.8 END AS equity,
               rev * 0.2 AS cfo, rev * -0.1 AS cfi, rev * 0.02 AS cff, rev * 0.12 AS net_cash, rev * 0.7 AS current_assets, rev * 0.35 AS current_liabilities, rev * 0.2 AS inventory,
               rev * 0.15 AS receivables, rev * 0.25 AS cash, rev * 0.9 AS debt, CASE WHEN company % 4 = 0 THEN 0.0 ELSE rev * -0.02 END AS interest
        FROM base)"""


def statement(t: Tables) -> DataFrame:
    n, c, rev = F.col("n"), F.col("company"), F.col("rev")
    base = t.orders.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("long").alias("yr")).agg(F.sum("o_totalprice").alias("rev"), F.count("*").alias("n"))
    part = {"cogs": 0.6, "opex": 0.1, "pretax": 0.28, "tax": 0.05, "net_income": 0.23, "assets": 2.0, "liabilities": 1.2, "cfo": 0.2, "cfi": -0.1, "cff": 0.02, "net_cash": 0.12, "current_assets": 0.7, "current_liabilities": 0.35, "inventory": 0.2, "receivables": 0.15, "cash": 0.25, "debt": 0.9}
    return base.select(
        "company", "yr", rev.alias("revenue"), *[(rev * v).alias(k) for k, v in part.items()],
        F.when(n % 5 != 0, rev * F.when(n % 7 == 0, 0.5).otherwise(0.4)).alias("gross_profit"), F.when(n % 3 != 0, rev * 0.3).alias("operating_income"),
        (rev * F.when(c % 9 == 0, 0.5).otherwise(0.8)).alias("equity"), F.when(c % 4 == 0, 0.0).otherwise(rev * -0.02).alias("interest"),
    )


_CLOSE = "coalesce(abs({a} - ({b})) <= greatest(1.0, 0.01 * greatest(abs({a}), abs({b}))), true)"
_HARD = [("assets", "liabilities + equity"), ("current_assets", "cash + receivables + inventory + revenue * 0.1"), ("gross_profit", "revenue - cogs"), ("operating_income", "gross_profit - opex"), ("net_income", "pretax - tax"), ("net_cash", "cfo + cfi + cff")]


@query(f"""WITH {STATEMENT}, x AS (SELECT company, yr, list_filter([{", ".join(f"CASE WHEN NOT {_CLOSE.format(a=a, b=b)} THEN '{a}' END" for a, b in _HARD)}], lambda v: v IS NOT NULL) AS hard_failed,
        CAST(coalesce(revenue < 0, false) AS INT) + CAST(coalesce(assets <= 0, false) AS INT) + CAST(coalesce(liabilities / assets >= 1, false) AS INT) AS soft_failed FROM st)
    SELECT *, CASE WHEN len(hard_failed) = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status FROM x""")  # fmt: skip
def report_gate(t: Tables) -> DataFrame:
    """FN-11: six hard identities within max(1, 1 %), three soft checks of sign and debt; only all hard ones make a report usable."""
    x = statement(t).withColumn("other_current", F.col("revenue") * 0.1)
    d = {k: F.col(k) for k in x.columns}
    hard, soft = fin.report_checks(d)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(k)) for k, ok in hard.items()]), lambda v: v.isNotNull())
    out = x.select("company", "yr", failed.alias("hard_failed"), sum((~ok).cast("int") for ok in soft.values()).alias("soft_failed"))
    return out.withColumn("status", F.when(F.size("hard_failed") == 0, "VERIFIED").otherwise("UNVERIFIED"))


@query(f"""WITH {STATEMENT}, x AS (SELECT company, yr, sum_up AS bottom_up, revenue FROM (SELECT *, revenue * (1 + (company % 13 - 6) * 1.1 / 100) AS sum_up FROM st))
    SELECT company, yr, round(bottom_up - revenue, 1) + 0.0 AS variance, round((bottom_up - revenue) / revenue, 4) + 0.0 AS variance_pct, abs((bottom_up - revenue) / revenue) <= 0.05 AS within FROM x""")  # fmt: skip
def calibration(t: Tables) -> DataFrame:
    """FN-13: what is summed from below against what was reported."""
    x = statement(t).select("company", "yr", (F.col("revenue") * (1 + (F.col("company") % 13 - 6) * 1.1 / 100)).alias("bottom_up"), "revenue")
    v = fin.calibration(F.col("bottom_up"), F.col("revenue"))
    return x.select("company", "yr", *[v[k].alias(k) for k in ("variance", "variance_pct", "within")])


@query(f"""WITH {STATEMENT}, a AS (SELECT *, coalesce(gross_profit, round(revenue - cogs, 4)) AS gp, gross_profit IS NULL AS gp_calc FROM st),
    b AS (SELECT *, coalesce(operating_income, round(gp - opex, 4)) AS oi, operating_income IS NULL AS oi_calc FROM a)
    SELECT company, yr, round(gp, 3) AS gross_profit, CASE WHEN gp_calc THEN 'CALC' ELSE 'RP' END AS gross_profit_source, round(oi, 3) AS operating_income,
           CASE WHEN oi_calc THEN 'CALC' ELSE 'RP' END AS operating_income_source, round(gp / revenue, 6) AS gross_margin, round(oi / revenue, 6) AS operating_margin, round(net_income / revenue, 6) AS net_margin FROM b""")  # fmt: skip
def calculated_cells(t: Tables) -> DataFrame:
    """FN-14: missing cells follow from rules in the order they are declared; what a rule gave serves the next."""
    x = fin.apply_calc_rules(statement(t), fin.CALC_RULES)
    return x.select(
        "company", "yr", F.round("gross_profit", 3).alias("gross_profit"), "gross_profit_source", F.round("operating_income", 3).alias("operating_income"), "operating_income_source",
        *[F.round(k, 6).alias(k) for k in ("gross_margin", "operating_margin", "net_margin")],
    )


@query(f"""WITH {STATEMENT}, c AS (
        SELECT company, yr, 'gross_profit' AS target, gross_profit AS v, revenue - cogs AS e, 0.02 AS tol FROM st UNION ALL
        SELECT company, yr, 'operating_income', operating_income, gross_profit - opex, 0.02 FROM st)
    SELECT company, yr, target, abs(v - e) / (abs(e) + 1e-6) < tol AS ok, round(abs(v - e) / (abs(e) + 1e-6) * 100, 2) AS diff_pct FROM c WHERE v IS NOT NULL AND e IS NOT NULL
    UNION ALL SELECT company, yr, 'gross_margin', abs(0.41 - gross_profit / revenue) / (gross_profit / revenue + 1e-6) < 0.05, round(abs(0.41 - gross_profit / revenue) / (gross_profit / revenue + 1e-6) * 100, 2) FROM st WHERE gross_profit IS NOT NULL""")  # fmt: skip
def identity_checks(t: Tables) -> DataFrame:
    """FN-15: differences within 2 %, ratios within 5 %; the stated gross margin is 0.41."""
    x = statement(t).withColumn("gross_margin", F.lit(0.41))
    return fin.identity_checks(x, ["company", "yr"], [("gross_profit", "revenue", "cogs", "sub"), ("operating_income", "gross_profit", "opex", "sub"), ("gross_margin", "gross_profit", "revenue", "div")])


@query(f"""WITH {STATEMENT}, long AS (SELECT company, yr, unnest(['gross_margin', 'operating_margin', 'net_margin', 'roe', 'roa']) AS ratio,
        unnest([gross_profit / revenue * 100, operating_income / revenue * 100, net_income / revenue * 100, net_income / equity * 100, net_income / assets * 100]) AS v FROM st)
    SELECT company, yr, ratio, round(v, 2) AS value FROM long WHERE v IS NOT NULL""")  # fmt: skip
def derived_ratios(t: Tables) -> DataFrame:
    """AG-11: ratios from facts in long form."""
    facts = statement(t).unpivot(["company", "yr"], ["revenue", "gross_profit", "operating_income", "net_income", "equity", "assets"], "canonical", "value")
    return fin.derived_ratios(facts, ["company", "yr"])


_BS = "(SELECT *, row_number() OVER (PARTITION BY company ORDER BY yr DESC) - 1 AS i, count(*) OVER (PARTITION BY company) AS many FROM st)"


@query(f"""WITH {STATEMENT}, inc AS {_BS}, bal AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY yr DESC) - 1 AS j, count(*) OVER (PARTITION BY company) AS held FROM st WHERE yr % 2 = 0),
    x AS (SELECT i.company, i.yr, i.i, i.revenue, i.gross_profit, i.operating_income, i.net_income, i.interest, b.assets, b.equity, b.current_assets, b.current_liabilities, b.inventory, b.receivables, b.cash, b.debt
        FROM inc i LEFT JOIN bal b ON b.company = i.company AND b.j = least(i.i, b.held - 1))
    SELECT company, yr, round(gross_profit / revenue * 100, 4) AS gross_margin_pct, round(operating_income / revenue * 100, 4) AS operating_margin_pct, round(net_income / revenue * 100, 4) AS net_margin_pct,
        round(net_income / assets * 100, 4) AS roa_pct, round(net_income / equity * 100, 4) AS roe_pct, round(current_assets / current_liabilities, 4) AS current_ratio, round((current_assets - inventory) / current_liabilities, 4) AS quick_ratio,
        round(cash / current_liabilities, 4) AS cash_ratio, round(debt / equity, 4) AS debt_to_equity, round(debt / assets, 4) AS debt_to_assets, CASE WHEN interest <> 0 THEN round(operating_income / abs(interest), 4) END AS interest_coverage,
        round(revenue / assets, 4) AS asset_turnover, round(inventory / revenue * 365, 4) AS inventory_days, round(receivables / revenue * 365, 4) AS receivable_days,
        round((revenue / lead(revenue) OVER w - 1) * 100, 4) AS revenue_yoy_pct, round((net_income / lead(net_income) OVER w - 1) * 100, 4) AS net_income_yoy_pct
    FROM x WINDOW w AS (PARTITION BY company ORDER BY yr DESC)""")  # fmt: skip
def ratio_suite(t: Tables) -> DataFrame:
    """AG-12 and JN-15: ratios per period; the i-th income statement meets the i-th balance sheet, or the last one there is (here every second year's)."""
    st = statement(t)
    income = st.select("company", "yr", "revenue", "gross_profit", "operating_income", "net_income", "interest")
    balance = st.where("yr % 2 = 0").select("company", "yr", "assets", "equity", "current_assets", "current_liabilities", "inventory", "receivables", "cash", "debt")
    x = fin.align_by_position(income, balance, "company", "yr")
    return fin.ratio_suite(x, "company", "yr")


@query(f"""WITH {STATEMENT}, g AS (SELECT company, yr, net_income * (1 + (company * yr) % 17 / 10.0) AS v, yr >= 1997 AS forecast FROM st),
    d AS (SELECT *, lag(v) OVER (PARTITION BY company ORDER BY yr) AS before, lag(v) OVER (PARTITION BY company, forecast ORDER BY yr) AS before_own FROM g),
    h AS (SELECT company, max(abs((v - before_own) / before_own)) AS most FROM d WHERE NOT forecast AND abs(before_own) > 0.01 GROUP BY 1)
    SELECT company, yr, round(abs((v - before) / before) * 100, 2) AS growth, round(most * 3 * 100, 2) AS allowed, abs((v - before) / before) <= most * 3 AS passed FROM d JOIN h USING (company) WHERE forecast AND abs(before) > 0.01 AND most IS NOT NULL""")  # fmt: skip
def growth_reasonableness(t: Tables) -> DataFrame:
    """WN-52: forecast growth is at most three times the largest growth of the past."""
    x = statement(t).select("company", "yr", (F.col("net_income") * (1 + (F.col("company") * F.col("yr")) % 17 / 10.0)).alias("v"), (F.col("yr") >= 1997).alias("forecast"))
    return fin.growth_reasonableness(x, "company", "yr")


_LABELS = ["Revenue", "net sales", "Gross Profit (NT$)", "營業收入", "Net income after tax", "Operating-Income", "Capital Spending", "eps", "total  equity", "Random Thing With A Very Long Name Beyond Forty Characters", *fin.CANONICAL, *(f" {k.lower()} %" for k in fin.CANONICAL)]
_NORM = "regexp_replace(label, '[\\s/()（）%,，]', '', 'g')"
_PAIRS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(fin.CANONICAL.items()))


@query(f"""WITH canon(i, k, v) AS (VALUES {_PAIRS}), x AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _LABELS)}][p_partkey % {len(_LABELS)} + 1] AS label FROM part)
    SELECT p_partkey, label, coalesce((SELECT v FROM canon WHERE k = label), (SELECT arg_min(v, i) FROM canon WHERE regexp_replace(k, '[\\s/()（）%,，]', '', 'g') = {_NORM}),
        (SELECT arg_min(v, i) FROM canon WHERE contains(lower(label), lower(k)) OR contains(lower(k), lower(label))), left(replace(lower(label), ' ', '_'), 40)) AS canonical FROM x""")  # fmt: skip
def canonical_labels(t: Tables) -> DataFrame:
    """TX-35: a label by itself, without punctuation, by containment either way (the first entry wins), or in snake case; each distinct label is looked up once."""
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    rows = t.part.select("p_partkey", label.alias("label"))
    return rows.join(fin.canonical_labels(rows.select("label").distinct()), "label").select("p_partkey", "label", "canonical")


_SYNONYMS = ", ".join(f"('{a}', '{k}')" for k, v in fin.SYNONYMS.items() for a in v)


@query(f"""WITH syn(alias, canonical) AS (VALUES {_SYNONYMS}), x AS (SELECT p_partkey, ['sales', 'EBIT', 'revenue', 'pat', 'unknown', 'net_worth'][p_partkey % 6 + 1] AS term FROM part)
    SELECT p_partkey, term, coalesce((SELECT canonical FROM syn WHERE alias = lower(term)), lower(term)) AS resolved,
        coalesce((SELECT count(*) FROM syn WHERE syn.canonical = coalesce((SELECT canonical FROM syn WHERE alias = lower(term)), lower(term))), 0) + 1 AS n_forms FROM x""")  # fmt: skip
def synonyms(t: Tables) -> DataFrame:
    """TX-34: a term resolves to its canonical form, and expands to all forms of that."""
    term = F.element_at(F.array(*[F.lit(x) for x in ("sales", "EBIT", "revenue", "pat", "unknown", "net_worth")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    resolved = fin.resolve(F.lower(term))
    return t.part.select("p_partkey", term.alias("term"), resolved.alias("resolved"), F.size(fin.expand(resolved)).cast("long").alias("n_forms"))


_PERIODS = ["2023A", "2024", "2025E", "2026F", "FY2022", "2021H", "2024p", "1Q23", "2030 E", "n.a."]


@query(f"""WITH x AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _PERIODS)}][p_partkey % {len(_PERIODS)} + 1] AS period FROM part)
    SELECT p_partkey, period, regexp_matches(period, '^20\\d{{2}}[AaHh]?$') AS historical, regexp_matches(period, '^20\\d{{2}}[EeFfPp]$') OR right(period, 1) IN ('E', 'F', 'P') AS forecast, TRY_CAST(nullif(regexp_extract(period, '20\\d{{2}}'), '') AS INT) AS yr FROM x""")  # fmt: skip
def periods(t: Tables) -> DataFrame:
    """TX-36: past or forecast by the letter behind the year."""
    period = F.element_at(F.array(*[F.lit(x) for x in _PERIODS]), (F.col("p_partkey") % len(_PERIODS) + 1).cast("int"))
    return t.part.select("p_partkey", period.alias("period"), fin.is_historical(period).alias("historical"), fin.is_forecast(period).alias("forecast"), fin.year_of(period).alias("yr"))


@query(f"""WITH {STATEMENT}, syn(alias, canonical) AS (VALUES {_SYNONYMS}),
    api AS (SELECT company, yr, CASE WHEN company % 5 = 0 THEN 'sales' WHEN company % 5 = 1 THEN 'cogs' ELSE 'revenue' END AS canonical,
                   CASE company % 5 WHEN 1 THEN -cogs WHEN 2 THEN revenue * 1000 WHEN 3 THEN revenue * 3 ELSE revenue END AS v FROM st WHERE NOT (company % 5 = 4 AND yr % 2 = 0)),
    want AS (SELECT company, yr, CASE WHEN company % 5 = 1 THEN 'cogs' ELSE 'revenue' END AS canonical, CASE WHEN company % 5 = 1 THEN cogs ELSE revenue END AS r FROM st),
    own AS (SELECT w.*, a.v FROM want w LEFT JOIN api a USING (company, yr, canonical)),
    s AS (SELECT w.company, w.yr, min(a.canonical) AS syn FROM want w JOIN syn ON syn.canonical = w.canonical JOIN api a ON a.company = w.company AND a.yr = w.yr AND a.canonical = syn.alias AND abs(w.r - a.v) / greatest(abs(a.v), 0.01) <= 0.01 GROUP BY 1, 2),
    near AS (SELECT w.company, w.yr, min(a.yr) AS near_yr FROM want w JOIN api a ON a.company = w.company AND a.canonical = w.canonical AND abs(a.yr - w.yr) = 1 AND abs(w.r - a.v) / greatest(abs(a.v), 0.01) <= 0.02 GROUP BY 1, 2)
    SELECT o.company, o.yr, CASE WHEN abs(r - v) / greatest(abs(v), 0.01) <= 0.01 THEN 0 WHEN syn IS NOT NULL THEN 1 WHEN o.canonical = 'cogs' AND abs(r + v) / greatest(abs(v), 0.01) <= 0.01 THEN 2
        WHEN abs(r - v / 1000) / greatest(abs(v / 1000), 0.01) <= 0.01 THEN 3 WHEN near_yr IS NOT NULL THEN 4 ELSE 99 END AS level FROM own o LEFT JOIN s USING (company, yr) LEFT JOIN near USING (company, yr)""")  # fmt: skip
def fallback_lookup(t: Tables) -> DataFrame:
    """JN-16: a value that disagrees is looked up by synonym, with its sign turned, in thousands, and in a neighbouring year."""
    st, k = statement(t), F.col("company") % 5
    api = st.where("not (company % 5 = 4 and yr % 2 = 0)").select("company", "yr", F.when(k == 0, "sales").when(k == 1, "cogs").otherwise("revenue").alias("canonical"), F.when(k == 1, -F.col("cogs")).when(k == 2, F.col("revenue") * 1000).when(k == 3, F.col("revenue") * 3).otherwise(F.col("revenue")).alias("v"))
    want = st.select("company", "yr", F.when(k == 1, "cogs").otherwise("revenue").alias("canonical"), F.when(k == 1, F.col("cogs")).otherwise(F.col("revenue")).alias("r"))
    return fin.fallback_lookup(want, api, 0.01)


_RATINGS = ["Buy", "strong buy", "OUTPERFORM", "Hold (maintain)", "neutral", "Sell", "", "no opinion", "reduce", "overweight"]
_RATING_PAIRS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(fin.RATINGS.items()))


@query(f"""WITH rating(i, k, v) AS (VALUES {_RATING_PAIRS}), x AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _RATINGS)}][p_partkey % {len(_RATINGS)} + 1] AS raw FROM part)
    SELECT p_partkey, raw, CASE WHEN raw = '' THEN 'NR' ELSE coalesce((SELECT v FROM rating WHERE k = lower(trim(raw))), (SELECT arg_min(v, i) FROM rating WHERE contains(lower(trim(raw)), k) OR contains(k, lower(trim(raw)))), 'UNKNOWN') END AS rating FROM x""")  # fmt: skip
def ratings(t: Tables) -> DataFrame:
    """TX-41"""
    raw = F.element_at(F.array(*[F.lit(x) for x in _RATINGS]), (F.col("p_partkey") % len(_RATINGS) + 1).cast("int"))
    return t.part.select("p_partkey", raw.alias("raw"), fin.rating(raw).alias("rating"))


@query("""WITH x AS (SELECT p_partkey, CAST(2015 + p_partkey % 25 AS VARCHAR) AS tok, p_partkey % 3 = 0 AS listed, CASE p_partkey % 4 WHEN 0 THEN '2024年' WHEN 1 THEN 'Q3 results' ELSE '' END AS near, CASE WHEN p_partkey % 11 = 0 THEN CAST(2015 + p_partkey % 25 AS VARCHAR) END AS first_page FROM part)
    SELECT p_partkey, tok, CASE WHEN CAST(tok AS INT) NOT BETWEEN 2021 AND 2030 THEN 'TICKER' WHEN tok = first_page OR listed THEN 'TICKER' WHEN regexp_matches(near, '年|Q|FY|季') THEN 'YEAR' ELSE 'AMBIGUOUS' END AS verdict,
        CASE WHEN CAST(tok AS INT) NOT BETWEEN 2021 AND 2030 THEN 1.0 WHEN tok = first_page THEN 0.97 WHEN listed THEN 0.9 WHEN regexp_matches(near, '年|Q|FY|季') THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence FROM x""")  # fmt: skip
def year_or_ticker(t: Tables) -> DataFrame:
    """TX-38"""
    k, tok = F.col("p_partkey"), (F.col("p_partkey") % 25 + 2015).cast("string")
    near = F.when(k % 4 == 0, "2024年").when(k % 4 == 1, "Q3 results").otherwise("")
    v = fin.year_or_ticker(tok, F.when(k % 11 == 0, tok), k % 3 == 0, near)
    return t.part.select("p_partkey", tok.alias("tok"), v["verdict"].alias("verdict"), v["confidence"].alias("confidence"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(1000 + p_partkey % 9000 AS VARCHAR) || '.TW' WHEN 1 THEN CAST(1000 + p_partkey % 9000 AS VARCHAR) || '.TWO' ELSE CAST(1000 + p_partkey % 9000 AS VARCHAR) END AS ticker, p_partkey % 3 <> 2 AS valid FROM part""")
def ticker_format(t: Tables) -> DataFrame:
    """TX-39: a code and its market give a ticker, whose form is checked."""
    k = F.col("p_partkey")
    ticker = fin.ticker((k % 9000 + 1000).cast("string"), F.when(k % 3 == 0, "TWSE").when(k % 3 == 1, "TPEX").otherwise("other"))
    return t.part.select("p_partkey", ticker.alias("ticker"), fin.valid_ticker(ticker).alias("valid"))


_NAMES = ["2330_TSMC_20240131.pdf", "report-2454 TT 2025E.pdf", "Q3 2023 outlook 6505.TW.docx", "0050 etf 2026.csv", "none"]


@query(f"""WITH x AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _NAMES)}][p_partkey % {len(_NAMES)} + 1] AS name FROM part)
    SELECT p_partkey, list_filter(list_distinct(regexp_extract_all(name, '(?:^|[^0-9])([1-9][0-9]{{3}})(?:$|[^0-9])', 1)), lambda c: NOT (CAST(c AS INT) BETWEEN 2021 AND 2030)) AS candidates FROM x""")  # fmt: skip
def ticker_candidates(t: Tables) -> DataFrame:
    """TX-37: numbers of four digits in a file name that are no years."""
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return t.part.select("p_partkey", fin.ticker_candidates(name).alias("candidates"))


@query(f"""WITH {STATEMENT}, p AS (SELECT company, yr, net_income, lag(net_income) OVER (PARTITION BY company ORDER BY yr) AS before FROM st)
    SELECT company, yr, round(net_income / before - 1, 4) AS yoy, CASE WHEN before IS NULL THEN 'FIRST' WHEN abs(net_income / before - 1) <= 0.5 THEN 'HIGH' WHEN abs(net_income / before - 1) <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p""")  # fmt: skip
def yoy_confidence(t: Tables) -> DataFrame:
    """AG-43 in part: a figure's confidence by its change against the year before."""
    before = F.lag("net_income").over(Window.partitionBy("company").orderBy("yr"))
    x = statement(t).select("company", "yr", (F.col("net_income") / before - 1).alias("yoy"))
    c = F.abs("yoy")
    return x.select("company", "yr", F.round("yoy", 4).alias("yoy"), F.when(F.col("yoy").isNull(), "FIRST").when(c <= 0.5, "HIGH").when(c <= 2, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("""SELECT p_partkey, round((p_size * 30.0 / p_retailprice - 1) * 100, 2) AS upside, CASE WHEN p_size >= 10 THEN round(p_retailprice / p_size, 4) END AS per, round(p_size / 10.0 / p_retailprice * 100, 4) AS cash_yield,
    round(p_size / 10.0 * 1.05, 4) AS next_dividend, CASE WHEN p_size >= 10 THEN round(p_size / p_retailprice * 100, 4) END AS earnings_yield, round(p_size * 2.5 / 1000, 6) AS book_per_share FROM part""")  # fmt: skip
def valuation(t: Tables) -> DataFrame:
    """FN-16 and FN-17: upside, earnings multiple, dividend and earnings yields, the next dividend 5 % up, book value per share."""
    p, s = F.col("p_retailprice"), F.col("p_size")
    eps = F.when(s >= 10, s.cast("double")).otherwise(0.0)
    v = fin.valuation(price=p, target=s * 30.0, eps=eps, dividend=s / 10.0, equity=s * 2.5, shares=F.lit(1000.0))
    return t.part.select("p_partkey", *[c.alias(k) for k, c in v.items()])
