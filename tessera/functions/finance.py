"""Labels, periods, tickers, ratings, statement identities and ratios, as expressions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels and the fields they mean, in the order in which they are tried.
CANONICAL = {
    "營業收入淨額": "revenue", "營業收入": "revenue", "收入": "revenue", "Revenue": "revenue", "Net Revenue": "revenue", "Net Sales": "revenue", "营收": "revenue", "Sales": "revenue", "Total Revenue": "revenue",
    "營業成本": "cogs", "Cost of Revenue": "cogs", "COGS": "cogs", "Cost of Sales": "cogs", "销售成本": "cogs", "营业成本": "cogs",
    "營業毛利淨額": "gross_profit", "毛利": "gross_profit", "Gross Profit": "gross_profit", "营业毛利淨額": "gross_profit",
    "營業費用": "opex", "Operating Expense": "opex", "OpEx": "opex", "SG&A": "opex", "营业費用": "opex",
    "營業淨利/損": "operating_income", "營業利益": "operating_income", "Operating Income": "operating_income", "EBIT": "operating_income", "营业淨利/損": "operating_income",
    "稅前淨利": "pretax_income", "Pretax Income": "pretax_income", "Pre-tax Income": "pretax_income", "税前淨利": "pretax_income",
    "稅後淨利": "net_income", "Net Income": "net_income", "Net Profit": "net_income", "税後淨利": "net_income", "歸屬母公司淨利": "net_income_parent", "Attributable Net": "net_income_parent",
    "每股盈餘(元)": "eps", "每股盈餘": "eps", "EPS": "eps", "EPS (NT$)": "eps", "Basic EPS": "basic_eps", "Diluted EPS": "diluted_eps", "每股净利": "eps",
    "毛利率": "gross_margin", "Gross Margin": "gross_margin", "營業利益率": "operating_margin", "Operating Margin": "operating_margin", "淨利率": "net_margin", "Net Margin": "net_margin",
    "營收成長率": "revenue_growth", "Revenue Growth": "revenue_growth", "YoY": "yoy_growth", "QoQ": "qoq_growth",
    "每股淨值": "bvps", "BVPS": "bvps", "Book Value Per Share": "bvps", "每股現金股利": "dps", "DPS": "dps", "Dividend Per Share": "dps",
    "本益比(P/E)": "pe_ratio", "P/E": "pe_ratio", "本益比": "pe_ratio", "股價淨值比": "pb_ratio", "P/B": "pb_ratio", "PBR": "pb_ratio", "殖利率": "dividend_yield", "Dividend Yield": "dividend_yield",
    "總資產": "total_assets", "Total Assets": "total_assets", "總負債": "total_liabilities", "Total Liabilities": "total_liabilities", "股東權益": "total_equity", "Total Equity": "total_equity",
    "流動資產": "current_assets", "Current Assets": "current_assets", "現金及約當現金": "cash", "Cash": "cash",
    "來自營業活動現金": "operating_cf", "Operating CF": "operating_cf", "投資活動現金": "investing_cf", "Investing CF": "investing_cf", "自由現金流量": "free_cf", "Free Cash Flow": "free_cf", "FCF": "free_cf", "資本支出": "capex", "CapEx": "capex",
    "股東權益報酬率": "roe", "ROE": "roe", "資產報酬率": "roa", "ROA": "roa",
}
# Fields and their other names.
SYNONYMS = {
    "revenue": ["gross_revenue", "net_sales", "sales", "top_line"],
    "gross_profit": ["gross_income", "gross"],
    "operating_income": ["ebit", "operating_profit", "op_income"],
    "net_income": ["profit_after_tax", "pat", "bottom_line", "net_profit"],
    "eps": ["basic_eps", "diluted_eps", "earnings_per_share"],
    "total_equity": ["shareholders_equity", "book_value_total", "net_worth"],
}
# Fields that some sources give with the other sign.
SIGN_TURNS = ["cogs", "capex", "investing_cf"]
# Target, operands and operation of rules that fill missing cells.
CALC_RULES = {
    "gross_profit": ("revenue", "cogs", "sub"),
    "operating_income": ("gross_profit", "opex", "sub"),
    "gross_margin": ("gross_profit", "revenue", "div"),
    "operating_margin": ("operating_income", "revenue", "div"),
    "net_margin": ("net_income", "revenue", "div"),
}
# Ratings as written and what they count as, in the order in which they are tried.
RATINGS = {"buy": "BUY", "outperform": "BUY", "overweight": "BUY", "hold": "HOLD", "neutral": "HOLD", "sell": "SELL", "underperform": "SELL", "reduce": "SELL"}


def close(a: Column, b: Column, least: float = 1.0, share: float = 0.01) -> Column:
    """Equal within max(least, share of the larger); what is missing is not held against it."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(least), share * F.greatest(F.abs(a), F.abs(b))), F.lit(True))


def report_checks(d: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Hard and soft checks of a statement by name; a check whose lines are missing holds."""
    sums = {
        "assets": d["liabilities"] + d["equity"], "current_assets": d["cash"] + d["receivables"] + d["inventory"] + d["other_current"], "gross_profit": d["revenue"] - d["cogs"],
        "operating_income": d["gross_profit"] - d["opex"], "net_income": d["pretax"] - d["tax"], "net_cash": d["cfo"] + d["cfi"] + d["cff"],
    }
    holds = lambda c: F.coalesce(c, F.lit(True))
    soft = {"revenue": holds(d["revenue"] >= 0), "assets": holds(d["assets"] > 0), "debt": holds(F.try_divide(d["liabilities"], d["assets"]) < 1)}
    return {k: close(d[k], v) for k, v in sums.items()}, soft


def calibration(bottom_up: Column, reported: Column, share: float = 0.05) -> Column:
    """variance, variance_pct, within; null against nothing reported."""
    pct = F.try_divide(bottom_up - reported, reported)
    return F.struct(F.when(reported != 0, F.round(bottom_up - reported, 1) + 0.0).alias("variance"), (F.round(pct, 4) + 0.0).alias("variance_pct"), (F.abs(pct) <= share).alias("within"))


def apply_calc_rules(rows: DataFrame, rules: dict) -> DataFrame:
    """The rows with missing targets filled from their operands, and a source (RP as reported, CALC, or ERR) of each target."""
    for target, (a, b, kind) in rules.items():
        got = F.round(F.col(a) - F.col(b), 4) if kind == "sub" else F.round(F.try_divide(F.col(a), F.col(b)), 6)
        have = F.col(target) if target in rows.columns else F.lit(None).cast("double")
        source = F.when(have.isNotNull(), "RP").when(got.isNotNull(), "CALC").otherwise("ERR")
        rows = rows.withColumns({f"{target}_source": source, target: F.coalesce(have, got)})
    return rows


def identity_checks(rows: DataFrame, keys: list[str], checks: list[tuple]) -> DataFrame:
    """keys, target, ok, diff_pct: one row for each check whose values are there."""
    parts = []
    for target, a, b, kind in checks:
        expected = F.col(a) - F.col(b) if kind == "sub" else F.try_divide(F.col(a), F.col(b))
        off = F.abs(F.col(target) - expected) / (F.abs(expected) + 1e-6)
        parts.append(F.struct(F.lit(target).alias("target"), (off < (0.02 if kind == "sub" else 0.05)).alias("ok"), F.round(off * 100, 2).alias("diff_pct")))
    return rows.select(*keys, F.inline(F.filter(F.array(*parts), lambda x: x["diff_pct"].isNotNull())))


def derived_ratios(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, value in percent, from facts (canonical, value)."""
    of = lambda k: F.max(F.when(F.col("canonical") == k, F.col("value"))).alias(k)
    wide = facts.groupBy(*keys).agg(*[of(k) for k in ("revenue", "gross_profit", "operating_income", "net_income", "equity", "assets")])
    parts = {"gross_margin": ("gross_profit", "revenue"), "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"), "roe": ("net_income", "equity"), "roa": ("net_income", "assets")}
    ratio = [F.struct(F.lit(k).alias("ratio"), F.round(F.try_divide(F.col(a), F.col(b)) * 100, 2).alias("value")) for k, (a, b) in parts.items()]
    return wide.select(*keys, F.inline(F.filter(F.array(*ratio), lambda x: x["value"].isNotNull())))


def align_by_position(left: DataFrame, right: DataFrame, key: str, period: str) -> DataFrame:
    """left with the columns of the right row at the same place, newest first, or of the last right row where there are fewer."""
    newest = Window.partitionBy(key).orderBy(F.desc(period))
    one = left.withColumn("__i", F.row_number().over(newest))
    other = right.withColumn("__j", F.row_number().over(newest)).withColumn("__held", F.count("*").over(Window.partitionBy(key))).drop(period)
    held = right.groupBy(key).agg(F.count("*").alias("__held"))
    placed = one.join(held, key, "left").withColumn("__j", F.least("__i", "__held")).drop("__held")
    return placed.join(other.drop("__held"), [key, "__j"], "left").drop("__i", "__j")


def ratio_suite(x: DataFrame, key: str, period: str) -> DataFrame:
    """Margins, returns, liquidity, debt and efficiency, and growth against the period before."""
    c, r = F.col, lambda a, b, by=1.0: F.round(F.try_divide(a, b) * by, 4)
    newest = Window.partitionBy(key).orderBy(F.desc(period))
    growth = lambda k: F.round((F.try_divide(c(k), F.lead(k).over(newest)) - 1) * 100, 4)
    rev, ca, cl = c("revenue"), c("current_assets"), c("current_liabilities")
    out = {
        "gross_margin_pct": r(c("gross_profit"), rev, 100), "operating_margin_pct": r(c("operating_income"), rev, 100), "net_margin_pct": r(c("net_income"), rev, 100),
        "roa_pct": r(c("net_income"), c("assets"), 100), "roe_pct": r(c("net_income"), c("equity"), 100), "current_ratio": r(ca, cl), "quick_ratio": r(ca - F.coalesce("inventory", F.lit(0)), cl),
        "cash_ratio": r(c("cash"), cl), "debt_to_equity": r(c("debt"), c("equity")), "debt_to_assets": r(c("debt"), c("assets")), "interest_coverage": r(c("operating_income"), F.abs("interest")),
        "asset_turnover": r(rev, c("assets")), "inventory_days": r(c("inventory"), rev, 365), "receivable_days": r(c("receivables"), rev, 365),
        "revenue_yoy_pct": growth("revenue"), "net_income_yoy_pct": growth("net_income"),
    }
    return x.select(key, period, *[v.alias(k) for k, v in out.items()])


def growth_reasonableness(x: DataFrame, key: str, period: str, times: float = 3.0) -> DataFrame:
    """key, period, growth, allowed, passed of forecasts; ``x`` has v and forecast. Growth from nearly nothing does not count."""
    order = Window.partitionBy(key).orderBy(period)
    change = lambda before: F.when(F.abs(before) > 0.01, F.abs((F.col("v") - before) / before))
    own = F.lag("v").over(Window.partitionBy(key, "forecast").orderBy(period))
    x = x.select(key, period, "forecast", change(F.lag("v").over(order)).alias("growth"), F.when(~F.col("forecast"), change(own)).alias("past"))
    x = x.withColumn("allowed", F.max("past").over(Window.partitionBy(key)) * times).where("forecast and growth is not null and allowed is not null")
    return x.select(key, period, F.round(F.col("growth") * 100, 2).alias("growth"), F.round(F.col("allowed") * 100, 2).alias("allowed"), (F.col("growth") <= F.col("allowed")).alias("passed"))


_PUNCTUATION = r"[\s/()（）%,，]"


def canonical_labels(labels: DataFrame) -> DataFrame:
    """label, canonical of distinct labels; the table of labels is small and fixed, so it is broadcast."""
    rows = [(i, k, v) for i, (k, v) in enumerate(CANONICAL.items())]
    known = F.broadcast(labels.sparkSession.createDataFrame(rows, "i int, k string, v string"))
    bare = lambda c: F.regexp_replace(c, _PUNCTUATION, "")
    level = F.when(F.col("k") == F.col("label"), 0).when(bare("k") == bare("label"), 1).when(F.contains(F.lower("label"), F.lower("k")) | F.contains(F.lower("k"), F.lower("label")), 2)
    best = labels.crossJoin(known).withColumn("level", level).groupBy("label").agg(F.min(F.when(F.col("level").isNotNull(), F.struct("level", "i", "v"))).alias("best"))
    return best.select("label", F.coalesce("best.v", F.substring(F.replace(F.lower("label"), F.lit(" "), F.lit("_")), 1, 40)).alias("canonical"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def resolve(term: Column) -> Column:
    """The canonical form of a term, or the term itself."""
    return F.coalesce(_map({a: k for k, v in SYNONYMS.items() for a in v})[term], term)


def expand(canonical: Column) -> Column:
    """All forms of a canonical term, itself first."""
    forms = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    return F.concat(F.array(canonical), F.coalesce(forms[canonical], F.array().cast("array<string>")))


def is_historical(period: Column) -> Column:
    return period.rlike(r"^20\d{2}[AaHh]?$")


def is_forecast(period: Column) -> Column:
    return period.rlike(r"^20\d{2}[EeFfPp]$") | period.rlike("[EFP]$")


def year_of(period: Column) -> Column:
    return F.nullif(F.regexp_extract(period, r"20\d{2}", 0), F.lit("")).cast("int")


def fallback_lookup(want: DataFrame, api: DataFrame, share: float) -> DataFrame:
    """company, yr, level: 0 agrees, 1 by synonym, 2 with the sign turned, 3 in thousands, 4 in a neighbouring year (twice the tolerance), 99 not at all."""
    near = lambda r, v, tol: F.coalesce(F.abs(r - v) / F.greatest(F.abs(v), F.lit(0.01)) <= tol, F.lit(False))
    key = ["company", "yr", "canonical"]
    own = api.withColumnRenamed("v", "own")
    by_name = api.select("company", "yr", resolve(F.col("canonical")).alias("name"), F.col("canonical").alias("alias"), F.col("v").alias("syn")).where("name <> alias").select("company", "yr", F.col("name").alias("canonical"), "syn")
    synonym = want.join(by_name, key).where(near(F.col("r"), F.col("syn"), share)).select(*key).distinct().withColumn("has_syn", F.lit(True))
    shifted = reduce(DataFrame.unionByName, [api.select("company", (F.col("yr") + d).alias("yr"), "canonical", F.col("v").alias("other")) for d in (-1, 1)])
    neighbour = want.join(shifted, key).where(near(F.col("r"), F.col("other"), 2 * share)).select(*key).distinct().withColumn("has_near", F.lit(True))
    r, v = F.col("r"), F.col("own")
    level = (
        F.when(near(r, v, share), 0).when(F.col("has_syn"), 1).when(F.col("canonical").isin(SIGN_TURNS) & near(r, -v, share), 2)
        .when(near(r, v / 1000, share), 3).when(F.col("has_near"), 4).otherwise(99)
    )
    return want.join(own, key, "left").join(synonym, key, "left").join(neighbour, key, "left").select("company", "yr", level.alias("level"))


def rating(raw: Column) -> Column:
    """By itself, by containment either way (the first entry wins), UNKNOWN, or NR for nothing."""
    r = F.lower(F.trim(raw))
    inside = F.coalesce(*[F.when(F.contains(r, F.lit(k)) | F.contains(F.lit(k), r), F.lit(v)) for k, v in RATINGS.items()])
    return F.when(F.coalesce(raw, F.lit("")) == "", "NR").otherwise(F.coalesce(_map(RATINGS)[r], inside, F.lit("UNKNOWN")))


def year_or_ticker(token: Column, first_page: Column, listed: Column, near: Column) -> Column:
    """verdict and confidence for numbers of four digits that may be a year (2021 to 2030)."""
    steps = [(~token.cast("int").between(2021, 2030), "TICKER", 1.0), (token == first_page, "TICKER", 0.97), (listed, "TICKER", 0.9), (near.rlike("年|Q|FY|季"), "YEAR", 0.9)]
    pick = lambda i, last: F.coalesce(*[F.when(s[0], F.lit(s[i])) for s in steps], F.lit(last))
    return F.struct(pick(1, "AMBIGUOUS").alias("verdict"), pick(2, 0.4).alias("confidence"))


def ticker(code: Column, market: Column) -> Column:
    return F.concat(code, F.when(market == "TWSE", ".TW").when(market == "TPEX", ".TWO").otherwise(""))


def valid_ticker(value: Column) -> Column:
    return value.rlike(r"^[1-9]\d{3}\.(TW|TWO)$")


def ticker_candidates(name: Column) -> Column:
    """Distinct numbers of exactly four digits, not beginning with 0, that are no years of 2021 to 2030; in order of place."""
    found = F.array_distinct(F.regexp_extract_all(name, F.lit(r"(?:^|[^0-9])([1-9][0-9]{3})(?:$|[^0-9])"), F.lit(1)))
    return F.filter(found, lambda c: ~c.cast("int").between(2021, 2030))


def valuation(price: Column, target: Column, eps: Column, dividend: Column, equity: Column, shares: Column) -> dict[str, Column]:
    """Ratios per share; earnings under 0.01 give no multiple."""
    earns = F.when(F.abs(eps) >= 0.01, eps)
    return {
        "upside": F.round((F.try_divide(target, price) - 1) * 100, 2), "per": F.round(F.try_divide(price, earns), 4), "cash_yield": F.round(F.try_divide(dividend, price) * 100, 4),
        "next_dividend": F.round(dividend * 1.05, 4), "earnings_yield": F.round(F.try_divide(earns, price) * 100, 4), "book_per_share": F.round(F.try_divide(equity, shares), 6),
    }
