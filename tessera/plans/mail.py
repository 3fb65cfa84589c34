"""Text functions over literal texts in several languages, dealt over whole tables, and over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import mail, text
from tessera.plans.registry import Tables, query
from tessera.sources import mailbox

_C, _W = mail.CJK, mail.WIDE_MARK


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


_MIXED = ["看一下dashboard的資料, 謝謝", "營收 成長  12%：很好", "plain english only", "第3季 EPS 4.5元", "  明天 開會  ", "混合text與123數字,好", "", "中文, 2,330 元", "日期:2026 或 說明:見下"]
_X = f"x AS (SELECT p_partkey, {_sql_pick(_MIXED, 'p_partkey')} AS t FROM part)"


@query(f"WITH {_X}, r AS (SELECT p_partkey, regexp_extract_all(t, '[{_C}]+|[A-Za-z]+|[0-9]+|\\s+|[^{_C}A-Za-z0-9\\s]+') AS runs FROM x) SELECT p_partkey, runs, list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[{_C}]') THEN 'cjk' WHEN regexp_matches(r, '^[A-Za-z]') THEN 'latin' WHEN regexp_matches(r, '^[0-9]') THEN 'digit' WHEN regexp_matches(r, '^\\s') THEN 'other' ELSE 'punct' END) AS scripts FROM r")
def script_runs(t: Tables) -> DataFrame:
    """TX-01"""
    runs = mail.script_runs(_pick(_MIXED, "p_partkey"))
    return t.part.select("p_partkey", runs["run"].alias("runs"), runs["script"].alias("scripts"))


def _twice(expr: str, pattern: str, to: str) -> str:
    once = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '{to}', 'g')"


_WIDE = "t"
for _n, _w in ((",", "，"), (":", "："), (r"\?", "？")):
    _WIDE = _twice(_WIDE, f"([{_C}]){_n}([^0-9]|$)", f"\\1{_w}\\2")
_SPACED = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"
for _p, _to in ((f"([{_C}{_W}])\\s+([{_C}{_W}])", "\\1\\2"), (f"([{_W}])\\s+", "\\1"), (f"\\s+([{_W}])", "\\1"), ("\\s+", " "), (f"([{_C}])([A-Za-z0-9])", "\\1 \\2"), (f"([A-Za-z0-9])([{_C}])", "\\1 \\2")):
    _SPACED = _twice(_SPACED, _p, _to)


@query(f"WITH {_X} SELECT p_partkey, {_WIDE} AS widened, {_SPACED} AS spaced FROM x")
def cjk_marks_and_spaces(t: Tables) -> DataFrame:
    """TX-05 and TX-06"""
    s = _pick(_MIXED, "p_partkey")
    return t.part.select("p_partkey", mail.widen_marks(s).alias("widened"), mail.cjk_spacing(s).alias("spaced"))


@query(f"WITH {_X}, n AS (SELECT p_partkey, length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS c, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l FROM x) SELECT p_partkey, CASE WHEN c + l = 0 THEN NULL WHEN c / (c + l) >= 0.85 THEN 'zh' WHEN c / (c + l) <= 0.15 THEN 'en' ELSE 'mixed' END AS lang FROM n")
def language_shares(t: Tables) -> DataFrame:
    """TX-03: all branches."""
    return t.part.select("p_partkey", text.script_share(_pick(_MIXED, "p_partkey")).alias("lang"))


@query(f"WITH {_X}, f AS (SELECT p_partkey, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9]+|[{_C}]{{2,4}}') AS found FROM x) SELECT p_partkey, flatten(list_transform(found, lambda m: CASE WHEN regexp_matches(m, '^[A-Za-z]') THEN [lower(m)] ELSE list_transform(range(1, length(m)), lambda i: substring(m, i, 2)) END)) AS tokens FROM f")
def text_tokens(t: Tables) -> DataFrame:
    """TX-29"""
    return t.part.select("p_partkey", mail.tokens(_pick(_MIXED, "p_partkey")).alias("tokens"))


_SUBJECTS = ["Re: PN-9942 delay", "FW: weekly report", "[ext] PO100 open", "Re: Re: weekly report", "hello"]
_REPLIES = ["", "<ABC.1@x.org> ", "no id"]


@query(f"""WITH x AS (SELECT event_id, {_sql_pick(_SUBJECTS, "event_id")} AS s, {_sql_pick(_REPLIES, "event_id")} AS r FROM events),
    k AS (SELECT event_id, s, nullif(regexp_extract(r, '<([^>]+)>', 1), '') AS mid, nullif(regexp_extract(s, '\\b([A-Za-z]{{2,5}}-\\d{{2,6}}|[A-Za-z]{{2,5}}\\d{{3,6}})\\b', 1), '') AS tkt FROM x)
    SELECT event_id, coalesce('MID:' || lower(mid), 'TKT:' || lower(replace(tkt, '-', '')), 'SUB:' || CASE s WHEN 'hello' THEN 'hello' ELSE 'weekly report' END) AS thread FROM k""")  # fmt: skip
def thread_keys(t: Tables) -> DataFrame:
    """TX-18"""
    s = _pick(_SUBJECTS, "event_id")
    return t.events.select("event_id", mail.thread_key(s, _pick(_REPLIES, "event_id"), text.subject_key(s)).alias("thread"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")  # fmt: skip
def page_texts(t: Tables) -> DataFrame:
    """TX-20"""
    return t.pages.select("page_id", mail.html_text(F.col("html")).alias("text"))


_DUE = ["2026-07-20", "7/15", "12-31", "7月15日", "EOD", "EOW", "eom", "next friday", "this monday", "2/30", "soon"]
_S = "lower(trim(raw))"
_SHORT = "'^(\\d{1,2})(?:[/-]|\\s*月\\s*)(\\d{1,2})(?:\\s*日)?$'"
_DAY = f"TRY_CAST(concat(YEAR_HERE, '-', lpad(regexp_extract({_S}, {_SHORT}, 1), 2, '0'), '-', lpad(regexp_extract({_S}, {_SHORT}, 2), 2, '0')) AS DATE)"
_THIS, _NEXT = _DAY.replace("YEAR_HERE", "year(a)"), _DAY.replace("YEAR_HERE", "year(a) + 1")
_NAMED = "'^(this|next)\\s+(monday|tuesday|wednesday|thursday|friday)$'"


@query(f"""WITH x AS (SELECT event_id, {_sql_pick(_DUE, "event_id")} AS raw, CAST(ts AS DATE) AS a FROM events)
    SELECT event_id, raw, CASE WHEN regexp_matches(raw, '^\\d{{4}}-') THEN TRY_CAST(raw AS DATE)
        WHEN regexp_matches({_S}, {_SHORT}) THEN CASE WHEN {_THIS} < a THEN {_NEXT} ELSE {_THIS} END
        WHEN {_S} = 'eod' THEN a WHEN {_S} = 'eow' THEN CAST(a + CAST((4 - (isodow(a) - 1) + 7) % 7 AS INT) AS DATE) WHEN {_S} = 'eom' THEN last_day(a)
        WHEN regexp_matches({_S}, {_NAMED}) THEN CAST(a + CAST((list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday'], regexp_extract({_S}, {_NAMED}, 2)) - isodow(a) + 7) % 7 + CASE WHEN raw LIKE 'next%' THEN 7 ELSE 0 END AS INT) AS DATE) END AS due FROM x""")  # fmt: skip
def deadlines(t: Tables) -> DataFrame:
    """TX-25"""
    raw = _pick(_DUE, "event_id")
    return t.events.select("event_id", raw.alias("raw"), mail.deadline(raw, F.to_date("ts")).alias("due"))


_BODIES = ["Please send the file by Friday. Thanks.", "請於 6/30 前回覆。其他不變。", "Nothing to do here", "We need to follow up next week; all else is fine; todo: plan 2026-07-01", "附件請確認；下週再談", "麻煩本周提供; 需要在這週排程", "務必月底前; 待月初追蹤", "盡快於週三回覆", "To-do: 1/234 is no day", "Action by Monday; pending this week; ASAP 下周", "follow-up 3.4 and 本週", "無事"]
_ASK = "(?i)" + "|".join(x.replace("-", "\\-") for x in mail.TRIGGERS)
# the same without looking ahead: a day and a month end before something that is no digit
_WHEN = "(?i)(\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2})|(\\d{1,2}[-/.]\\d{1,2})(?:[^0-9]|$)|(下週|下周|本週|本周|這週|月底|月初|週[一二三四五]|next week|this week|by \\w+)"


@query(f"""WITH x AS (SELECT p_partkey, unnest(regexp_split_to_array({_sql_pick(_BODIES, "p_partkey")}, '[。.\n；;]')) AS s FROM part)
    SELECT p_partkey, left(trim(s), 120) AS action, concat({", ".join(f"coalesce(regexp_extract(s, '{_WHEN}', {i}), '')" for i in (1, 2, 3))}) AS due FROM x WHERE regexp_matches(s, '{_ASK}')""")  # fmt: skip
def action_items(t: Tables) -> DataFrame:
    """TX-26: sentences that ask for something, and by when."""
    found = t.part.select("p_partkey", F.explode(mail.actions(_pick(_BODIES, "p_partkey"))).alias("a"))
    return found.select("p_partkey", F.col("a.text").alias("action"), "a.due")


_SIGNED = ["Tony(2026/07/13): Yes\nAnn（2026-07-14）：no\nrest", "none here", "A(2026/1/2): tba\nB(2026/1/2): yes\nC(2026/1/2): NO\nD(2026/1/2): Yes\nE(2026/1/2): Yes\nF(2026/1/2): Yes", "x Bob Lee (2026/07/13) : Yes"]
_LINE = "'(?im)^[ \\t]*([^\\n()（）:：]{1,40}?)\\s*[（(](\\d{4}[/-]\\d{1,2}[/-]\\d{1,2})[)）]\\s*[:：]\\s*(Yes|No|TBA)[ \\t]*$'"


@query(f"""WITH x AS (SELECT p_partkey, {_sql_pick(_SIGNED, "p_partkey")} AS b FROM part), y AS (SELECT p_partkey, regexp_extract_all(b, {_LINE}, 1)[:5] AS n, regexp_extract_all(b, {_LINE}, 2)[:5] AS d, regexp_extract_all(b, {_LINE}, 3)[:5] AS k FROM x)
    SELECT p_partkey, trim(unnest(n)) AS name, unnest(d) AS day, unnest(list_transform(k, lambda v: CASE upper(v) WHEN 'TBA' THEN 'TBA' WHEN 'YES' THEN 'Yes' ELSE 'No' END)) AS decision FROM y""")  # fmt: skip
def sign_offs(t: Tables) -> DataFrame:
    """TX-27"""
    return t.part.select("p_partkey", F.inline(mail.sign_offs(_pick(_SIGNED, "p_partkey"))))


_CASES = ["see case 7", "CASE-0012 and case 3", "case_5", "nothing", "Case12345"]


@query(f"WITH x AS (SELECT p_partkey, regexp_extract({_sql_pick(_CASES, 'p_partkey')}, '(?i)case[-_ ]?(\\d+)', 1) AS n FROM part) SELECT p_partkey, CASE WHEN n <> '' THEN 'CASE-' || CASE WHEN length(n) > 4 THEN left(n, 4) ELSE lpad(n, 4, '0') END END AS case_id FROM x")
def case_ids(t: Tables) -> DataFrame:
    """TX-28"""
    return t.part.select("p_partkey", text.case_id(_pick(_CASES, "p_partkey")).alias("case_id"))


_NOISY = ["hello\n-----Original Message-----\nold", "text\nFrom: someone\nmore", "all of it stays", "body\n-- \nsig", "a\nThis message may be confidential"]


@query(f"WITH x AS (SELECT p_partkey, p_partkey % {len(_NOISY)} AS k FROM part) SELECT p_partkey, ['hello', 'text', 'all of it stays', 'body', 'a'][k + 1] AS body FROM x")
def mail_bodies(t: Tables) -> DataFrame:
    """TX-22"""
    return t.part.select("p_partkey", text.without_reply_chain(_pick(_NOISY, "p_partkey")).alias("body"))


_BUCKETS = {"power": ["battery", "charger", "volt"], "screen": ["panel", "pixel", "dead", "row"]}
_TITLES = ["battery volt low", "dead pixel row panel", "charger near panel", "nothing known"]


@query(f"""WITH x AS (SELECT p_partkey, string_split({_sql_pick(_TITLES, "p_partkey")}, ' ') AS w FROM part), s AS (SELECT p_partkey, len(list_intersect(w, ['battery', 'charger', 'volt'])) / sqrt(3) AS a, len(list_intersect(w, ['panel', 'pixel', 'dead', 'row'])) / sqrt(4) AS b FROM x)
    SELECT p_partkey, CASE WHEN greatest(a, b) = 0 THEN NULL WHEN a >= 1.3 * b THEN 'power' WHEN b >= 1.3 * a THEN 'screen' END AS bucket FROM s""")  # fmt: skip
def fuzzy_buckets(t: Tables) -> DataFrame:
    """TX-32: the bucket of most shared words by the root of its size, if it is 1.3 times the next."""
    w = F.split(_pick(_TITLES, "p_partkey"), " ")
    score = {k: text.overlap_score(w, F.array(*[F.lit(x) for x in v])) for k, v in _BUCKETS.items()}
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(k).alias("k")) for k, s in score.items()]))
    clear = (ranked[0]["s"] < 0) & (ranked[0]["s"] <= 1.3 * ranked[1]["s"])
    return t.part.select("p_partkey", F.when(clear, ranked[0]["k"]).alias("bucket"))


@query("""
    SELECT conv_id, turn, role || '@example.org' AS sender, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 MINUTE * (conv_id * 10 + turn) AS sent, trim(regexp_extract(text, '^[^.!?\n]*')) AS subject, text AS body,
           CASE turn % 4 WHEN 1 THEN CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'decoded-as:utf-8' ELSE '' END WHEN 2 THEN 'decoded-as:utf-8' ELSE '' END AS note FROM conversations""")
def mail_files(t: Tables) -> DataFrame:
    """SRC-13 and TX-21: every turn written as a mail file, with four notations of dates and right, wrong, unknown and missing character sets, and read back."""
    k = F.pmod("turn", F.lit(4))
    at = F.timestamp_add("MINUTE", F.col("conv_id") * 10 + F.col("turn"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    date = F.element_at(F.array(F.concat(F.date_format(at, "E, "), F.date_format(at, mailbox.DATES[0])), F.date_format(at, mailbox.DATES[1]), F.date_format(at, mailbox.DATES[2]), F.date_format(at, mailbox.DATES[3])), (k + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain; charset=no-such-set", 'text/plain; charset="UTF-8"'])), (k + 1).cast("int"))
    subject = F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0))
    lines = ["From: Someone <", F.col("role"), "@example.org>\nDate: ", date, "\nSubject: =?UTF-8?B?", F.regexp_replace(F.base64(subject.cast("binary")), "\\s", ""), "?=\nMIME-Version: 1.0\nContent-Transfer-Encoding: 8bit\nContent-Type: ", kind, "\n\n", F.col("text")]
    files = t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines]).cast("binary").alias("content"))
    read = mailbox.mail_rows(files)
    number = lambda i: F.split("path", "/")[i].cast("long")
    return read.select(number(0).alias("conv_id"), number(1).alias("turn"), "sender", "sent", "subject", "body", "note")


# Words that mark a point of importance.
IMPORTANT = ["需", "請", "務必", "截止", "deadline", "決定", "問題", "風險", "延遲", "異常", "變更", "確認", "核准", "客戶", "交期"]


@query(f"""
    WITH marked AS (SELECT conv_id, turn, text, regexp_matches(text, '{"|".join(IMPORTANT)}|[0-9]{{4}}[-/][0-9]') OR turn % 3 = 0 AS point FROM conversations),
    point AS (SELECT conv_id, list(left(text, 80) ORDER BY turn)[1:6] AS points FROM marked WHERE point GROUP BY conv_id),
    word AS (SELECT conv_id, w, count(*) AS n, min(turn * 1000000 + i) AS first FROM (
        SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]{{3,}}|[一-鿿]{{2,4}}') AS ws FROM conversations)) GROUP BY conv_id, w),
    term AS (SELECT conv_id, list(w ORDER BY n DESC, first)[1:8] AS terms FROM word GROUP BY conv_id)
    SELECT conv_id, coalesce(terms, []) AS terms, coalesce(points, []) AS points FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN term USING (conv_id) LEFT JOIN point USING (conv_id)""")
def conversation_summaries(t: Tables) -> DataFrame:
    """TX-51: the eight most frequent words of each conversation, of equals those met first, and the first six turns of weight (here also every third, as no text names any)."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}|[一-鿿]{2,4}"), F.lit(0))
    words = t.conversations.select("conv_id", "turn", F.posexplode(found).alias("i", "w")).groupBy("conv_id", "w").agg(F.count("*").alias("n"), F.min(F.struct("turn", "i")).alias("first"))
    top = words.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "w"))), 1, 8).alias("top"))
    weight = F.col("text").rlike("|".join(IMPORTANT) + "|[0-9]{4}[-/][0-9]") | (F.col("turn") % 3 == 0)
    points = t.conversations.where(weight).groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", F.left("text", F.lit(80)).alias("text")))), 1, 6).alias("points"))
    every = t.conversations.select("conv_id").distinct().join(top, "conv_id", "left").join(points, "conv_id", "left")
    none = F.array().cast("array<string>")
    return every.select("conv_id", F.coalesce(F.transform("top", lambda x: x["w"]), none).alias("terms"), F.coalesce(F.transform("points", lambda x: x["text"]), none).alias("points"))
