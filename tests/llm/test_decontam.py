import hashlib
import random
import re

import pytest

from tessera.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by looking at every place of every document."""
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made():
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "cd", "Ef", "é", "x1", "gh", "ij"]) + rng.choice("pqrstu")
    items = [(i, ", ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(3, "another text of item three with more than ten words in it all told"), (40, None), (41, ""), (42, "..."), (None, "no id at all but enough words to make up two windows")]
    docs = []
    for i in range(60):
        t = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            t[len(t) // 2 : len(t) // 2] = words(rng.choice(items)[1])[rng.choice([0, 0, 1]) :]
        docs.append((i, " ".join(t).upper() if i % 5 == 0 else " - ".join(t)))
    return docs + [(7, docs[7][1]), (None, docs[9][1]), (90, None), (91, ""), (92, "!?"), (93, "aa " * 30_000 + (items[1][1] or ""))], items


@pytest.mark.parametrize("block", [200_000, 20])
def test_as_brute_force(spark, block):
    docs, items = made()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, hits string, n_words int")
    bench = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in decontam.match_benchmark(df, bench, block).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == want
    clean = decontam.drop_contaminated(df, bench, block)
    assert clean.columns == df.columns and sorted((r[0] for r in clean.collect()), key=str) == sorted((r[0] for r in want if not r[-1]), key=str)


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["n_words"] for r in decontam.match_benchmark(docs, bench).collect()] == [2]
    assert decontam.drop_contaminated(docs, bench).count() == 1
    assert decontam.match_benchmark(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
