import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.words import runs, words_of
import pyarrow as pa

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_links(rows, least):
    """Pairs of row numbers of at least this similarity, by dictionaries of words alone."""
    n, found = len(rows), [shingles(t) for _, t in rows]
    df = Counter(x for c in found for x in c)
    data = [{x: k * math.log1p(n / max(df[x], n / 2000, 1)) for x, k in c.items()} for c in found]
    total = [sum(d.values()) for d in data]
    where = defaultdict(list)
    for i, d in enumerate(data):
        for x in d:
            where[x].append(i)
    links = set()
    for i, d in enumerate(data):
        both = Counter()
        for x, w in d.items():
            for j in where[x]:
                if j < i:
                    both[j] += min(w, data[j][x])
        links |= {(i, j) for j, b in both.items() if b >= least * (total[i] + total[j] - b)}
    return links


def brute(rows, least):
    """doc_id -> smallest doc_id of its component, over all pairs."""
    comp, links = [r[0] for r in rows], brute_links(rows, least)
    while True:
        old = list(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if old == comp:
            return {r[0]: c for r, c in zip(rows, comp)}


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows, base = text(40), [], [text(rng.randint(60, 200)) for _ in range(12)]
    for i in range(150):
        b = list(rng.choice(base))
        if i % 3 == 0:
            for _ in range(rng.randint(0, 4)):
                b[rng.randrange(len(b))] = word()
        elif i % 3 == 1:
            b = text(30) + passage + text(30)
        rows.append((i, " ".join(b)))
    return rows + [(200, None), (201, ""), (202, "!!"), (203, "one two"), (204, "One, two"), (205, "one")]


@pytest.mark.parametrize("block", [400, 3])
def test_groups_as_brute_force(spark, block):
    rows = made(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 0.8)
    got = minhash.near_duplicates(docs, bands=20, block=block).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == want
    kept = Counter(r["group_id"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == set(want.values())


def test_recall_against_all_pairs_at_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, links = brute(rows, 0.8), brute_links(rows, 0.8)
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(docs).collect()}
    near = [(i, j) for i, j in links if rows[i][1] != rows[j][1]]
    assert len(links) > 50 and len(near) > 5
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in near) >= 0.98 * len(near)
    assert all(want[i] == want[g] for i, g in got.items())


def test_document_frequencies_are_exact(spark):
    rows = made(5)
    rarity = minhash.count_rarity(spark.createDataFrame(rows, SCHEMA).repartition(5))
    df = Counter(x for _, t in rows for x in shingles(t))
    for text, n in df.items():
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        h, _, _ = minhash.distinct_shingles(*words_of(raw, np.array([0, len(raw)])).doc_shingles(5))
        assert math.isclose(rarity.of(h)[0], math.log1p(len(rows) / n))


def test_one_of_each_group_stays(spark):
    t = "a b c d e f g h i j k l"
    rows = [(5, t, "x"), (3, t, None), (3, t, "y"), (None, t, "z"), (None, None, "n"), (9, "", "e"), (8, "q r s t u v w", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leader string")
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter([(3, t), (None, None), (9, ""), (8, "q r s t u v w")]) or Counter((r[0], r[1]) for r in got.collect()) == Counter([(None, t), (None, None), (9, ""), (8, "q r s t u v w")])
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0 and minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    wx, wy = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
    sig = [minhash.signatures(h, np.zeros(300, dtype=np.int64), w, 1, 500)[0] for w in (wx, wy)]
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()) < 0.06
