"""Numbers as reports write them: parsing, units, rounding, formatting, derived figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to a million, and words that stand for a missing number.
UNITS = {"one": 1e-6, "thousand": 1e-3, "million": 1.0, "ten_million": 10.0, "hundred_million": 100.0, "billion": 1000.0}
MISSING = ["", "-", "--", "n/a", "na", "nan", "none", "null", "nm"]


def parse_number(text: Column) -> Column:
    """A number with thousands commas; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def clean_ocr_number(text: Column) -> Column:
    """Sentinels are null, brackets negate, per cent signs go, letters O and l among digits are 0 and 1."""
    t = F.lower(F.trim(text))
    negative = t.rlike(r"^[(（].*[)）]$")
    digits = F.regexp_replace(F.translate(F.regexp_replace(t, r"[(),%（）$\s]", ""), "ol", "01"), r"^\+", "")
    value = digits.try_cast("double")
    return F.when(~t.isin(*MISSING), F.when(negative, -value).otherwise(value))


def to_million(value: Column, unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return value * F.try_element_at(table, unit)


def round_then_floor(value: Column, digits: int) -> Column:
    return F.floor(F.bround(value, digits) * 10**digits) / 10**digits


def confidence(base: Column, failed: Column, agreeing: Column) -> Column:
    """Less for failed checks, more for agreeing sources, within 0 and 1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - 0.1 * failed + 0.05 * agreeing)), 3)


def upside(target: Column, price: Column) -> Column:
    return F.round((F.try_divide(target, price) - 1) * 100, 2)


def price_earnings(price: Column, eps: Column) -> Column:
    """Null where earnings are next to nothing."""
    return F.when(F.abs(eps) >= 0.01, F.try_divide(price, eps))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def size_text(size: Column) -> Column:
    """Bytes in the largest unit that gives at least one."""
    out = F.format_string("%d B", size.cast("long"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**i, F.format_string(f"%.1f {unit}", size / 1024.0**i)).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.5, "C").otherwise("D")


def cost_structure(unit_variable: Column, fixed_cost: Column, price: Column, volume: Column) -> Column:
    """Contribution of a unit, volume to break even, operating leverage."""
    unit = price - unit_variable
    return F.struct(unit.alias("unit_contribution"), F.try_divide(fixed_cost, unit).alias("breakeven_units"), F.try_divide(unit * volume, unit * volume - fixed_cost).alias("operating_leverage"))


def failed_checks(d: dict[str, Column]) -> Column:
    """Names of the accounting identities that do not hold within max(1, 1 %); a missing side is not judged."""
    close = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1.0), 0.01 * F.abs(b))
    rules = {
        "gross_profit": (d["revenue"] - d["cogs"], d["gross_profit"]), "operating_income": (d["gross_profit"] - d["opex"], d["operating_income"]),
        "net_income": (d["pretax"] - d["tax"], d["net_income"]), "balance": (d["liabilities"] + d["equity"], d["assets"]),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(close(a, b), F.lit(True)), name) for name, (a, b) in rules.items()]))
