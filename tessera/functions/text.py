"""Text normalisation, extraction and classification by built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII and its half-width twins.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def half_width(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def script_share(text: Column) -> Column:
    """zh, en or mixed by the share of CJK among letters; null without letters."""
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    share = F.try_divide(cjk.cast("double"), (cjk + latin).cast("double"))
    return F.when(share >= 0.85, "zh").when(share <= 0.15, "en").when(share.isNotNull(), "mixed")


def subject_key(subject: Column) -> Column:
    """A subject without reply marks and bracketed tags, lower-cased."""
    bare = F.regexp_replace(F.trim(subject), r"(?i)^((re|fw|fwd|aw|wg)\s*[:：]\s*|\[[^\]]*\]\s*)+", "")
    return F.lower(squeeze(bare))


def address(text: Column) -> Column:
    """The mail address in a text, else the text, lower-cased."""
    found = F.regexp_extract(text, r"([\w.+-]+@[\w-]+\.[\w.-]+)", 1)
    return F.lower(F.when(found != "", found).otherwise(F.trim(text)))


def without_reply_chain(text: Column) -> Column:
    """The text up to the earliest mark of a quoted mail, a signature or a disclaimer."""
    marks = [r"(?m)^-{2,}\s*Original Message", r"(?m)^From: ", r"(?m)^-- ?$", r"(?i)this (e-?mail|message) (is|may be) confidential"]
    places = [F.nullif(F.regexp_instr(text, F.lit(m)), F.lit(0)) for m in marks]
    return F.regexp_replace(F.coalesce(F.left(text, F.least(*places) - 1), text), r"\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences as an array; a point between digits ends none."""
    cut = F.split(text, r"(?<=[!?。！？\n])|(?<=\.)(?!\d)")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def overlap_score(a: Column, bucket: Column) -> Column:
    """Words shared with a bucket over the root of its size."""
    return F.try_divide(F.size(F.array_intersect(a, bucket)).cast("double"), F.sqrt(F.size(bucket).cast("double")))


def entities(text: Column) -> Column:
    """E-mail addresses, urls, amounts and dates in a text, as arrays by kind."""
    kinds = {"email": r"([\w.+-]+@[\w-]+\.[A-Za-z]{2,})", "url": r"(https?://[^\s\"'<>]+)", "date": r"(\d{4}-\d{2}-\d{2})", "number": r"(\d+(?:\.\d+)?)"}
    return F.struct(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias(k) for k, p in kinds.items()])


def mask(text: Column) -> Column:
    """Addresses and long digit runs replaced by sentinels."""
    return F.regexp_replace(F.regexp_replace(text, r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}", "<EMAIL>"), r"\d{7,}", "<NUMBER>")


def case_id(text: Column) -> Column:
    """CASE-7 and case 7 become CASE-0007; null without one."""
    n = F.regexp_extract(text, r"(?i)case[-_ ]?(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("CASE-"), F.lpad(n, 4, "0")))


def gate(confidence: Column, by_model: Column) -> Column:
    """auto, review or reject; a model's confidence counts up to 0.8 only."""
    c = F.when(by_model, F.least(confidence, F.lit(0.8))).otherwise(confidence)
    return F.when(c >= 0.85, "auto").when(c >= 0.5, "review").otherwise("reject")


def parse_date(text: Column) -> Column:
    """A day in one of several notations; the first that fits."""
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy", "MMM d, yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]).cast("date")


def roc_year(day: Column) -> Column:
    return F.year(day) - 1911
