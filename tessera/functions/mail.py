"""Mail and transcript text: scripts, spacing, threads, deadlines, actions, sign-offs and tokens, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of characters.
CJK, WIDE_MARK = "一-鿿㐀-䶿", "　-〿＀-／：-］"
# Words that ask for something.
TRIGGERS = [
    "請", "麻煩", "需要", "需", "務必", "盡快", "待", "追蹤", "確認", "回覆", "提供", "排", "todo", "to-do", "action", "follow up", "follow-up", "need to", "please", "by ", "pending", "asap",
]
# Notations of a deadline inside a text.
DUE = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}(?!\d)|下週|下周|本週|本周|這週|月底|月初|週[一二三四五]|next week|this week|by \w+)"


def script_runs(text: Column) -> Column:
    """Runs of one script, in order: array of (script, run), where a script is cjk, latin, digit, punct or other (white space)."""
    pattern = f"([{CJK}]+|[A-Za-z]+|[0-9]+|\\s+|[^{CJK}A-Za-z0-9\\s]+)"
    kind = lambda r: F.when(r.rlike(f"^[{CJK}]"), "cjk").when(r.rlike("^[A-Za-z]"), "latin").when(r.rlike("^[0-9]"), "digit").when(r.rlike(r"^\s"), "other").otherwise("punct")
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda r: F.struct(kind(r).alias("script"), r.alias("run")))


def widen_marks(text: Column) -> Column:
    """Commas and colons behind a CJK character become wide, unless a digit follows."""
    for narrow, wide in ((",", "，"), (":", "："), (r"\?", "？")):
        text = F.regexp_replace(text, f"(?<=[{CJK}]){narrow}(?![0-9])", wide)
    return text


def cjk_spacing(text: Column) -> Column:
    """No space between CJK characters or at wide marks, one where CJK meets Latin or digits, one elsewhere, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), f"(?<=[{CJK}{WIDE_MARK}])\\s+(?=[{CJK}{WIDE_MARK}])", "")
    text = F.regexp_replace(text, f"(?<=[{WIDE_MARK}])\\s+|\\s+(?=[{WIDE_MARK}])", "")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), f"(?<=[{CJK}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{CJK}])", " ")


def thread_key(subject: Column, reply_to: Column, bare: Column) -> Column:
    """By the id of the mail answered, a ticket in the subject, or the subject without reply marks (``bare``)."""
    mid = F.nullif(F.regexp_extract(reply_to, "<([^>]+)>", 1), F.lit(""))
    ticket = F.nullif(F.regexp_extract(subject, r"\b([A-Za-z]{2,5}-\d{2,6}|[A-Za-z]{2,5}\d{3,6})\b", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("MID:"), F.lower(F.trim(mid))), F.concat(F.lit("TKT:"), F.lower(F.regexp_replace(ticket, r"[-\s]", ""))), F.concat(F.lit("SUB:"), bare))


def html_text(html: Column) -> Column:
    """Text of small pages and mails: scripts, styles and tags go, five references are decoded, white space is one space."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def deadline(raw: Column, anchor: Column) -> Column:
    """A day from 2026-07-20, 7/15, 7月15日, EOD, EOW (Friday), EOM, and this or next weekday; days of the year gone by mean next year's."""
    s = F.lower(F.trim(raw))
    part = lambda p, i: F.regexp_extract(s, p, i)
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y.cast("string"), m, d), "yyyy-M-d")
    iso, short = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", r"^(\d{1,2})(?:[/-]|\s*月\s*)(\d{1,2})(?:\s*日)?$"
    this_year = date(F.year(anchor), part(short, 1), part(short, 2))
    later = F.when(this_year < anchor, date(F.year(anchor) + 1, part(short, 1), part(short, 2))).otherwise(this_year)
    monday0 = F.weekday(anchor)
    named = r"^(this|next)\s+(monday|tuesday|wednesday|thursday|friday)$"
    place = F.array_position(F.array(*[F.lit(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday")]), part(named, 2)).cast("int") - 1
    ahead = F.pmod(place - monday0, F.lit(7)) + F.when(part(named, 1) == "next", 7).otherwise(0)
    return (
        F.when(s.rlike(iso), date(part(iso, 1), part(iso, 2), part(iso, 3))).when(s.rlike(short), later).when(s.isin("eod", "end of day"), anchor)
        .when(s.isin("eow", "end of week"), F.date_add(anchor, F.pmod(4 - monday0, F.lit(7)).cast("int"))).when(s.isin("eom", "end of month"), F.last_day(anchor)).when(s.rlike(named), F.date_add(anchor, ahead.cast("int")))
    )


def actions(text: Column) -> Column:
    """Sentences that ask for something: array of (text, due), due empty where none is named."""
    ask = "(?i)" + "|".join(t.replace("-", r"\-") for t in TRIGGERS)
    due = lambda s: F.regexp_extract(s, "(?i)" + DUE, 1)
    return F.transform(F.filter(F.split(text, "[。.\\n；;]"), lambda s: s.rlike(ask)), lambda s: F.struct(F.substring(F.trim(s), 1, 120).alias("text"), due(s).alias("due")))


def sign_offs(body: Column) -> Column:
    """The first five lines of the form ``Name (2026/07/13): Yes``, as (name, day, decision)."""
    line = r"(?im)^[ \t]*([^\n()（）:：]{1,40}?)\s*[（(](\d{4}[/-]\d{1,2}[/-]\d{1,2})[)）]\s*[:：]\s*(Yes|No|TBA)[ \t]*$"
    parts = [F.regexp_extract_all(body, F.lit(line), F.lit(i)) for i in (1, 2, 3)]
    decision = lambda d: F.when(F.upper(d) == "TBA", "TBA").otherwise(F.initcap(d))
    return F.slice(F.transform(F.arrays_zip(*[p.alias(k) for p, k in zip(parts, "abc")]), lambda x: F.struct(F.trim(x["a"]).alias("name"), x["b"].alias("day"), decision(x["c"]).alias("decision"))), 1, 5)


def tokens(text: Column) -> Column:
    """Latin words of two characters and more, lower-cased, and pairs of neighbouring CJK characters in runs of two to four."""
    found = F.regexp_extract_all(text, F.lit(f"([A-Za-z][A-Za-z0-9]+|[{CJK}]{{2,4}})"), F.lit(1))
    pairs = lambda m: F.transform(F.sequence(F.lit(1), F.length(m) - 1), lambda i: F.substring(m, i, F.lit(2)))
    return F.flatten(F.transform(found, lambda m: F.when(m.rlike("^[A-Za-z]"), F.array(F.lower(m))).otherwise(pairs(m))))
