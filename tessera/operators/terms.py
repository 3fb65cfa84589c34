"""Terms mined from texts: abbreviations with the words they stand for, and pairs of terms that occur together oftener than by chance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words before a bracket that can be the long form of an abbreviation of n characters: the smaller of n + 5 and 2 n.
_BRACKET = r"((?:[^\s()（）]+\s+){0,12}[^\s()（）]+)\s*[(（]([A-Za-z][A-Za-z0-9&.-]{1,9})[)）]"


def long_form(before: str, short: str) -> str | None:
    """The shortest end of ``before`` that ``short`` abbreviates: its letters and digits found from right to left, the first at the start of a word."""
    words = before.split()
    text = " ".join(words[-min(len(short) + 5, 2 * len(short)) :])
    at = len(text)
    for k in range(len(short) - 1, -1, -1):
        c = short[k].lower()
        if not c.isalnum():
            continue
        at -= 1
        while at >= 0 and (text[at].lower() != c or k == 0 and at > 0 and text[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
    start = text.rfind(" ", 0, at + 1) + 1
    found = text[start:]
    return found if len(found) > len(short) and found.lower() != short.lower() else None


@F.pandas_udf(StringType())
def _long_form(before: pd.Series, short: pd.Series) -> pd.Series:
    return pd.Series([long_form(b, s) for b, s in zip(before, short)], dtype=object)


def abbreviations(texts: DataFrame, text: str, least: int = 1) -> DataFrame:
    """short, long, n: how many texts explain an abbreviation in brackets so; at least ``least``. Long forms are compared in lower case."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(_BRACKET), F.lit(1)).alias("before"), F.regexp_extract_all(text, F.lit(_BRACKET), F.lit(2)).alias("short"))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.explode(found).alias("f")).select("row", "f.short", F.lower(_long_form("f.before", "f.short")).alias("long"))
    return rows.where("long is not null").distinct().groupBy("short", "long").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _term(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)


def log_likelihood(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's G squared of the two-by-two table of texts with both terms, with each, and all."""
    both, a, b, n = (x.cast("double") for x in (both, a, b, n))
    return 2 * (_term(both, a * b / n) + _term(a - both, a * (n - b) / n) + _term(b - both, (n - a) * b / n) + _term(n - a - b + both, (n - a) * (n - b) / n))


def associated(texts: DataFrame, terms: Column, least: int = 2, significant: float = 10.83) -> DataFrame:
    """a, b (a before b), n_both, n_a, n_b, score of pairs of terms that stand together in at least ``least`` texts and oftener than by chance, at a score of ``significant`` or more.

    Three counts make a score: of each term, of both, and of all texts. ``terms`` is a text's array of terms; repeats count once. Terms that
    stand in fewer than ``least`` texts leave before pairs are made, so pairs of a text grow with the square of its frequent terms: give it short texts.
    """
    held = texts.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(terms).alias("terms"))
    total = F.broadcast(held.agg(F.count("*").alias("n")))
    spread = held.select("row", F.explode("terms").alias("term"))
    counts = spread.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= least)
    frequent = spread.join(counts, "term").groupBy("row").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    first = frequent.select(F.posexplode("terms").alias("i", "a"), "terms")
    pairs = first.select("a", F.explode(F.slice("terms", F.col("i") + 2, F.size("terms"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    scored = pairs.join(counts.select(F.col("term").alias("a"), F.col("n_term").alias("n_a")), "a").join(counts.select(F.col("term").alias("b"), F.col("n_term").alias("n_b")), "b").crossJoin(total)
    scored = scored.where(F.col("n_both") * F.col("n") > F.col("n_a") * F.col("n_b")).withColumn("score", log_likelihood(*map(F.col, ("n_both", "n_a", "n_b", "n"))))
    return scored.where(F.col("score") >= significant).select("a", "b", "n_both", "n_a", "n_b", "score")
