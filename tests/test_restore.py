"""Subject groups, tables, patches, terms and calibration against plain Python."""

import difflib
import itertools
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibrate, grouping, patches, tables, terms
from tessera.plans.restore import KINDS, QUICK_KINDS, first_sentence

FOLDER = "/root/testdata/sf0.001"


def sequential_groups(rows):
    """Each text in order against every member of every group founded so far."""

    def tokens(s):
        return {w for w in re.findall("[a-z0-9]+|[一-鿿]", s.lower()) if w not in grouping.STOP}

    def similar(new, old):
        a, b = tokens(new), tokens(old)
        share = len(a & b) / len(a | b) if a | b else 0.0
        return round(0.5 * share + 0.5 * difflib.SequenceMatcher(None, new.lower(), old.lower()).ratio(), 3)

    members, out = {}, {}
    for place, s in sorted(rows):
        best, most = None, 0.0
        for founder, texts in members.items():
            x = max(similar(s, o) for o in texts)
            if x > most:
                best, most = founder, x
        if best is not None and most >= 0.55:
            members[best].append(s)
            out[place] = (best, most)
        else:
            members[place] = [s]
            out[place] = (place, 1.0)
    return out


def test_groups_of_all_conversations(spark):
    items = spark.read.parquet(f"{FOLDER}/conversations.parquet").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("place"), first_sentence(F.col("text")).alias("s"))
    got = {r["place"]: (r["founder"], r["similarity"]) for r in grouping.greedy_groups(items, "place", "s").collect()}
    assert got == sequential_groups([tuple(r) for r in items.collect()])


def test_groups_of_made_subjects(spark):
    rng = random.Random(1)
    stems = ["battery cover crack", "PVT yield report", "motor noise issue", "下週 出貨 排程", "cable harness delay", "firmware update plan"]
    rows = []
    for i in range(160):
        s = rng.choice(stems)
        for _ in range(rng.randint(0, 2)):
            s = rng.choice([f"Re: {s}", s.upper(), s + f" {rng.randint(1, 4)}", s.replace("e", "a", 1), " ".join(reversed(s.split())), s + " for review"])
        rows.append((i * 3, s))
    rows += [(1000, ""), (1001, ""), (1002, "!!"), (1003, "the of"), (1004, None), (1005, "battery cover crack")]
    df = spark.createDataFrame(rows, "place long, s string")
    got = {r["place"]: (r["founder"], r["similarity"]) for r in grouping.greedy_groups(df, "place", "s").collect()}
    want = sequential_groups([(i, s or "") for i, s in rows])
    assert got == want and 6 <= len({f for f, _ in want.values()}) < 60
    assert grouping.greedy_groups(df.limit(0), "place", "s").count() == 0
    names = {r["founder"]: (r["n_members"], r["name"]) for r in grouping.group_names(grouping.greedy_groups(df, "place", "s"), "s").collect()}
    assert sum(n for n, _ in names.values()) == len(rows) and any("battery" in (name or "") for _, name in names.values())


def test_groups_from_many_blocks(spark, monkeypatch):
    """All pairs are looked at in pairs of blocks, also in small chunks, and no pair of texts that share a word is shuffled."""
    rng = random.Random(3)
    words = ["report", "yield", "motor", "Éclair", "ab12", "下週", "出貨", "noise", "plan", "eeeeeeeeeeeeeeeeeeee" * 3]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + rng.choice(["", "!", " of it"])) for i in rng.sample(range(1000), 120)]
    monkeypatch.setattr(grouping, "BLOCK", 25)
    df = spark.createDataFrame(rows, "place long, s string")
    got = {r["place"]: (r["founder"], r["similarity"]) for r in grouping.greedy_groups(df, "place", "s").collect()}
    assert got == sequential_groups(rows)
    texts = df.withColumnRenamed("s", "subject")
    found = grouping._most_similar(texts)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    best = lambda pairs: {y: (s, {x for x, b, t in pairs if b == y and t == s}) for y, s in {y: max(t for _, b, t in pairs if b == y) for _, y, _ in pairs}.items()}
    every = [(x, y, grouping.similarity(t, o)) for y, t in rows for x, o in rows if x < y]
    every = [p for p in every if p[2] >= grouping.THRESHOLD]
    assert best([tuple(r) for r in found.collect()]) == best(every)
    monkeypatch.setattr(grouping, "CHUNK", 7)
    monkeypatch.setattr(grouping, "WAITING", 5)
    alone = grouping._best_of_blocks(texts.toPandas().assign(own=0, other=0, task=0))
    assert best(list(alone.itertuples(index=False, name=None))) == best(every) and len(alone) <= len(every)


def test_groups_compare_only_texts_that_common_words_leave(spark, monkeypatch):
    """Texts without a common word are never compared by characters, nor those whose characters in the same order can't reach the threshold."""
    pairs = []

    class Counted(difflib.SequenceMatcher):
        def __init__(self, junk, new, old):
            pairs.append((new, old))
            super().__init__(junk, new, old)

    monkeypatch.setattr(grouping, "SequenceMatcher", Counted)
    run = lambda texts: grouping._best_of_blocks(pd.DataFrame({"place": range(len(texts)), "subject": texts, "own": 0, "other": 0, "task": 0}))
    apart = sorted({"".join(p) for p in itertools.permutations("abcdefg")})[::4]
    assert len(run(apart)) == 0 and not pairs
    assert len(run(["abcdefgh ijklmnop qrst same", "same tsrq ponmlkji hgfedcba"])) == 0 and not pairs
    many = [f"{'same ' * 3}{' '.join(f'{c}{i}' for c in 'abcd')}" for i in range(300)] + ["Same " + " ".join(f"w{i}" for i in range(400)) + x for x in ("", " x")]
    assert [tuple(r) for r in run(many).itertuples(index=False)] == [(300, 301, grouping.similarity(many[301], many[300]))]


def test_long_chains_of_founders(spark, tmp_path):
    links = [(i, i - 1) for i in range(1, 200)] + [(i, i - 7) for i in range(50, 200, 11)] + [(300, 250), (300, 0), (301, 300), (302, 301), (302, 250)]
    got = {r["item"]: r["founder"] for r in grouping._founders(spark.createDataFrame(links, "y long, x long"), str(tmp_path)).collect()}
    assert got == {i: 0 for i in [*range(1, 200), 300, 301, 302]}


def repaired(spark, text):
    cells = tables.cells_of_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    return [(r["is_header"], r["cells"], r["padded"], r["merged"]) for r in tables.repair_tables(cells, "id", "line", "cells").orderBy("row").collect()]


def test_ragged_tables(spark):
    assert repaired(spark, 'item|q|"price"\r\nbolt|5|1.20\n\nnut|7\nwasher and\nlong tail\na|b|c|d||e') == [
        (True, ["item", "q", "price"], 0, 0), (False, ["bolt", "5", "1.20"], 0, 0), (False, ["nut", "7", "washer and long tail"], 1, 2), (False, ["a", "b", "c d e"], 0, 0),
    ]
    assert repaired(spark, "1;2\n3;x") == [(False, ["1", "2"], 0, 0), (False, ["3", "x"], 0, 0)]
    assert repaired(spark, "one\ntwo") == [(True, ["one"], 0, 0), (False, ["two"], 0, 0)]
    assert repaired(spark, None) == repaired(spark, " \n") == []


def test_restored_values(spark):
    rows = [(1, 1, ["NT$m", "x"]), (1, 2, ["Item", "2023A", "2024E"]), (1, 3, [" Net  sales ", "1,200", "(30)"]), (1, 4, ["", "9"]), (1, 5, ["2023A 2024E"]), (1, 6, ["Tax", "1", "2", "3"]), (2, 1, ["a", "b"])]
    got = tables.restore_values(spark.createDataFrame(rows, "id int, row int, cells array<string>"), "id", "row", "cells")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, "Net sales", "2023A", "1,200"), (1, 3, "Net sales", "2024E", "(30)"), (1, 6, "Tax", "2023A", "1"), (1, 6, "Tax", "2024E", "2"), (1, 6, "Tax", "col2", "3"), (2, 1, "a", "col0", "b")]


def test_claims_and_patches(spark):
    text = "Mail a.b@c.org now 12 kg, 2024-01-02!"
    kinds = [("mail", 1, r"[a-z.]+@[a-z.]+"), ("word", 2, "[A-Za-z]+"), ("date", 3, r"\d{4}-\d\d-\d\d"), ("number", 4, r"\d+")]
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "é中 7")], "id int, text string")
    kept = patches.resolve_claims(patches.find_claims(df, "id", "text", kinds), "id")
    assert sorted((r["id"], r["start"], r["end"], r["kind"]) for r in kept.collect()) == [(1, 0, 4, "word"), (1, 5, 14, "mail"), (1, 15, 18, "word"), (1, 19, 21, "number"), (1, 22, 24, "word"), (1, 26, 36, "date"), (4, 3, 4, "number")]
    assert all((text, "", "é中 7")[[1, 3, 4].index(r["id"])][r["start"] : r["end"]] == r["found"] for r in kept.collect())


def test_claims_are_places_of_matches(spark):
    """Texts with the mark itself, whole matches, neighbours and matches inside words; the quick patterns find what the plain ones find, in one reading of the texts."""
    rng = random.Random(4)
    bits = ["ab", "a.b@c.org", "_d@e.ff", "x@y.zz_w@v.uu", "lower case.", "one two three.", "a b.c d.", ".", "@", "é", "中", "\n", " ", "\uffff", "12,5", "Big word"]
    rows = [(i, "".join(rng.choice(bits[: 16 - 3 * (i % 2)]) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, ""), (302, "\uffff"), (303, "a@b.cc")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(2)
    found = patches.find_claims(df, "id", "text", QUICK_KINDS)
    want = [(i, kind, n, m.start(), m.end(), m.group()) for i, text in rows for kind, n, pattern in KINDS for m in re.finditer(pattern, text or "")]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and {w[1] for w in want} >= {"mail", "pair", "opening", "number"}
    assert sorted(tuple(r) for r in patches.find_claims(df, "id", "text", KINDS).collect()) == sorted(want)
    plan = patches.resolve_claims(found, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Exchange") == 1


def test_overlaps_by_priority(spark):
    rng = random.Random(6)
    claims = [(d, f"k{rng.randint(0, 3)}", rng.randint(1, 4), s, s + rng.randint(1, 9)) for d in range(20) for s in rng.sample(range(60), 25)]
    want = set()
    for d in range(20):
        kept = []
        for c in sorted((c for c in claims if c[0] == d), key=lambda c: (c[2], c[3], c[3] - c[4], c[4], c[1])):
            if not any(c[3] < k[4] and c[4] > k[3] for k in kept):
                kept.append(c)
        want |= set(kept)
    got = patches.resolve_claims(spark.createDataFrame(claims, "id int, kind string, priority int, start int, end int"), "id").select("id", "kind", "priority", "start", "end")
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(
    ("text", "given", "want"),
    [
        ("abcdef", [(4, 5, "e", "EE"), (0, 2, "ab", "")], "cdEEf"), ("abc", [], "abc"), ("abc", [(3, 3, "", "!")], "abc!"), ("中文é", [(1, 2, "文", "x中")], "中x中é"),
        ("abc", [(2, 4, "c", "")], "span"), ("abc", [(0, 1, "b", "")], "before"), ("abcd", [(0, 2, "ab", "x"), (1, 3, "bc", "y")], "overlap"),
    ],
)
def test_patches_fit_or_are_named(spark, text, given, want):
    df = spark.createDataFrame([(text, given)], f"t string, p array<{patches.PATCH}>").withColumn("p", patches.in_order(F.col("p")))
    r = df.select(patches.problem(F.col("t"), F.col("p")).alias("why"), patches.applied(F.col("t"), F.col("p")).alias("new"), patches.applied(patches.applied(F.col("t"), F.col("p")), patches.inverse(F.col("p"))).alias("back")).head()
    assert (r["why"] or r["new"]) == want and (r["why"] or r["back"] == text)


def test_long_forms():
    assert terms.long_form("we use a heat shock protein", "HSP") == "heat shock protein"
    assert terms.long_form("the Federal Reserve", "FR") == "Federal Reserve" and terms.long_form("resonant converter", "LLC") is None
    assert terms.long_form("design for six sigma", "DFSS") == "design for six sigma" and terms.long_form("HSP", "HSP") is None and terms.long_form("", "AB") is None


def test_planted_abbreviations(spark):
    rows = [("We build a power delivery network (PDN) here.",)] * 3 + [("A printed circuit board (PCB) and a bill of materials (BOM).",), ("nothing (here) to see (XYZ)",), (None,), ("",)]
    got = {(r["short"], r["long"], r["n"]) for r in terms.abbreviations(spark.createDataFrame(rows, "text string"), "text").collect()}
    assert got == {("PDN", "power delivery network", 3), ("PCB", "printed circuit board", 1), ("BOM", "bill of materials", 1)}


def rerun(rows, grid):
    """Each event left out: all thresholds on the days of the others, from the start."""
    truth, score = [r[2] for r in rows], [r[3] for r in rows]
    events, last = [], False
    for i, x in enumerate(truth):
        if x and not last:
            events.append([])
        if x:
            events[-1].append(i)
        last = x
    out = {}
    for k, event in enumerate(events, 1):
        train = {i for j, e in enumerate(events, 1) if j != k for i in e}
        calm = [i for i in range(len(rows)) if not any(abs(i - j) <= 3 for j in train)]
        best = None
        for g in grid:
            on = [s is not None and s > g for s in score]
            value = sum(on[i] for i in train) / len(train) - 2 * (sum(on[i] for i in calm) / len(calm) if calm else 0) if train else None
            if best is None or value is not None and (best[1] is None or value > best[1]):
                best = (g, value)
        out[k] = (len(event), best[0], best[1], sum(score[i] is not None and score[i] > best[0] for i in event) / len(event))
    return out


def test_left_out_scores_equal_reruns(spark):
    rng, rows, grid = random.Random(2), [], [0.0, 0.5, 1.0, 2.0]
    for key in "abc":
        on = False
        for i in range(150 if key != "c" else 9):
            on = rng.random() < (0.6 if on else 0.08) or key == "c" and 3 <= i <= 4
            rows.append((key, i, on, None if rng.random() < 0.05 else rng.gauss(1.2 if on else 0.0, 1.0)))
    got = calibrate.leave_one_event_out(spark.createDataFrame(rows, "key string, day int, truth boolean, score double"), "key", "day", "truth", "score", grid)
    got = {(r["key"], r["event"]): (r["days"], r["threshold"], r["objective"], r["recall"]) for r in got.collect()}
    want = {(key, k): v for key in "abc" for k, v in rerun([r for r in rows if r[0] == key], grid).items()}
    assert set(got) == set(want) and len(want) > 15
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_mail_files(spark):
    from tessera.sources import mailbox

    plain = "From: A B <a@b.c>\r\nDate: Fri, 1 May 2026 13:05:00 +0000\r\nSubject: =?big5?B?pOim7g==?=\r\nContent-Type: text/plain; charset=big5\r\n\r\n".encode()
    multi = b"Message-ID: <1@x>\nContent-Type: multipart/mixed; boundary=zz\n\n--zz\nContent-Type: text/html\n\n<p>x</p>\n--zz\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nw6k=\n--zz--\n"
    files = [("a", plain + "交期確認".encode("big5")), ("b", multi), ("c", b""), ("d", None), ("e", b"\n\n" + b"\xff\xfe bad"), ("f", "Content-Type: text/plain; charset=utf-8\n\n".encode() + "客戶問題".encode().decode("latin-1").encode())]
    got = {r["path"]: r for r in mailbox.mail_rows(spark.createDataFrame(files, "path string, content binary")).collect()}
    a = got["a"]
    assert (a["sender"], a["body"], a["note"], str(a["sent"])) == ("a@b.c", "交期確認", "", "2026-05-01 13:05:00") and a["subject"] == bytes([0xA4, 0xE8, 0xA6, 0xEE]).decode("big5")
    assert (got["b"]["message_id"], got["b"]["body"]) == ("<1@x>", "é") and got["c"]["body"] == got["d"]["body"] == "" and got["c"]["sent"] is None
    assert got["e"]["note"].startswith("decoded-as:") and (got["f"]["body"], got["f"]["note"]) == ("客戶問題", "mojibake-fixed:latin-1->utf8")


def test_patches_of_a_long_text_take_time_in_proportion(spark):
    piece = "\ufeffaé12 \U0001f600the "  # a mark that decoding might take, and characters of one to four bytes
    k = 12_000
    text = piece * k
    edits = [(i * len(piece) + 3, i * len(piece) + 5, "12", "#" * (i % 4)) for i in range(k)]
    df = spark.createDataFrame([(text, edits), (None, []), ("", [])], f"t string, p array<{patches.PATCH}>")
    began = time.monotonic()
    new = patches.applied(F.col("t"), F.col("p"))
    got = df.select(patches.problem(F.col("t"), F.col("p")).alias("why"), new.alias("new"), F.col("p"), F.col("t")).withColumn("back", patches.applied(F.col("new"), patches.inverse(F.col("p")))).select("why", "new", "back").collect()
    assert time.monotonic() - began < 20
    assert tuple(got[0]) == (None, "".join(f"\ufeffaé{'#' * (i % 4)} \U0001f600the " for i in range(k)), text)
    assert [tuple(r) for r in got[1:]] == [(None, None, None), (None, "", "")]
