import os
import random
import re

import pytest

from tessera.llm import linerules, queries

duckdb = pytest.importorskip("duckdb")
SCHEMA = "doc_id long, text string, n_words string, kept int"
GOOD = "This line says something of use and it ends as sentences do."


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def made(n=150):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé世") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", "!", "|", "#"])
    texts = ["".join(word() + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", " "]) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return texts + [t + t for t in texts[:20]] + [None, "", " \n\t", "one", "a b", "a b c", "a b c " * 30, "x " * 100, "\n".join([GOOD] * 12), "x y " * 50_000 + "end."]


def test_counts_as_brute_force(spark):
    texts = made()
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(None, GOOD, None, None), (0, texts[0], None, None)]
    got = linerules.clean_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        (GOOD, 0), ("Les.", 0), ('He said "yes." and left', 0), ("これは文です。次", 0), ("No sentence here", 1), ("###!! $$ %% a.", 1), ("Wow! Yes! No!", 0),
        ("Home | News | Sport | Contact", 2), ("One. Two » Three » Four", 2), ("Home About Contact", 2), ("home", 2), ("next page", 2), ("Home is where the heart is.", 0),
        ("We use cookies to make this site better.", 3), ("© Copyright 2020. All rights reserved.", 3), ("Please enable JavaScript to go on.", 3), ("Alle Rechte vorbehalten.", 3),
        ("The overall rights reserveds are none.", 0), ("She said that all rights reserved for her were lost, " + "and so on, " * 30 + "until the end.", 0),
    ],
)
def test_line_rules(spark, line, rule):
    r = linerules.clean_lines(spark.createDataFrame([(1, f"\n{line}\n \n{GOOD}", None, None)], SCHEMA)).head()
    found = [k for k, n in enumerate((r["n_punctuation_lines"], r["n_navigation_lines"], r["n_boilerplate_lines"]), 1) if n]
    assert found == [rule] * (rule > 0)
    assert r["clean_text"] == (f"{line}\n{GOOD}" if rule == 0 else GOOD)
    assert r["lost_chars"] == (0 if rule == 0 else len("".join(line.split())))


def test_texts_that_lose_too_much_go(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(12)) + "." for _ in range(10)]
    nav = ["Home | News | Sport | Contact | Help"] * 3
    many = [" | ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(12)) for _ in range(12)]
    rows = [(1, "\n".join(good), None, None), (2, "\n".join(good + nav), None, None), (3, "\n".join(good + many), None, None)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in linerules.clean_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, False)}
    assert linerules.clean_lines(spark.createDataFrame(rows, SCHEMA), most_lost=100).where("kept").count() == 3


def test_oracle_and_empty(spark, tmp_path):
    rows = [(i, t, None, None) for i, t in enumerate(made()[:-1])] + [(None, GOOD, None, None)]  # without the longest: the SQL's slices grow with its square
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(linerules.ORACLE_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.select(*got.columns).fetchall()))
    assert linerules.clean_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_native(spark):
    plan = linerules.clean_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Exchange|Pandas", plan)
    assert os.path.exists("/root/testdata/sf0.001/documents.parquet")
