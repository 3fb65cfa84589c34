import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries, tandem

SCHEMA = "doc_id long, text string"


def brute(words):
    """(start, length, period) of all maximal runs of two periods and more, by comparing every pair of places."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= 2 * p and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng, most=60):
    n, k = rng.randint(0, most), rng.randint(1, 5)
    s = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


def test_runs_as_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        s = made(rng)
        words = np.array(s, dtype=np.int64)
        want = brute(s)
        if s:
            assert sorted(map(tuple, tandem.runs_of_stretch(words).tolist())) == sorted(want)
        assert list(map(tuple, tandem.runs_of_words(words).tolist())) == [r for r in want if r[1] >= 12]


def test_tree_and_blocks():
    rng = random.Random(4)
    for _ in range(300):
        s = made(rng, 30)
        tree = tandem.SuffixTree(s)
        assert sorted(tree.depth[v] for v in tree.leaf[: len(s)]) == list(range(2, len(s) + 2))
        seen = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
        for v in set(range(1, len(tree.parent))) - set(tree.leaf):
            path = tree.words[tree.first(v) : tree.first(v) + tree.depth[v]]
            assert tuple(path) in seen and tree.first(v) == min(i for i in range(len(s)) if s[i : i + len(path)] == path)
            link = tree.link[v]
            assert tree.words[tree.first(link) : tree.first(link) + tree.depth[link]] == path[1:] or tree.depth[v] == 1
        edges = tree.blocks()
        for a, b in zip(edges, edges[1:]):
            earlier = [k for i in range(a) for k in [next((k for k in range(len(s) - a) if s[i + k] != s[a + k]), len(s) - a)]]
            assert b - a == max(1, max(earlier, default=0))


@pytest.mark.parametrize("words", [[0] * 20_000, [i % 6000 for i in range(20_000)], [i % 7 for i in range(15_000)] + list(range(9, 5000))])
def test_long_periods(words):
    (run,) = tandem.runs_of_words(np.array(words)).tolist()
    assert run == [0, 20_000, 1] or run == [0, 20_000, 6000] or run == [0, 15_000, 7]


def report(rows):
    """The rows of op11 by the brute force above."""
    out = set()
    for doc, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = [r for r in brute(words) if r[1] >= 12]
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, k, p in found for i in range(s + p, s + k)}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in found).encode()
        out.add((doc, len(found), *best, 1000 * best[1] // best[2] if best[1] else None, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def test_query_as_brute_force(spark, tmp_path):
    rng = random.Random(5)
    gap = lambda: rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c "])
    text = lambda s: rng.choice(["", " "]) + "".join(f"{'w' if w else 'é x\u0085'}{w}{gap()}" for w in s)
    rows = [(i, text(made(rng, 80))) for i in range(400)] + [(7, "a b " * 20), (7, "a b " * 20), (500, None), (501, ""), (502, " \n "), (None, "x " * 12), (None, None), (20, None), (504, "y " * 11)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", n_words int, runs string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(rows) and set(got) == report(rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r for r in map(tuple, docs.collect()) if len((r[1] or "").split()) < 500]
    got = tandem.run_digests(tandem.find_runs(tandem.with_cycles(spark.createDataFrame(rows, SCHEMA))))
    assert {tuple(r) for r in got.collect()} == report(rows) and len(rows) > 120


def test_empty_table_and_long_text(spark):
    assert tandem.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    row = tandem.find_runs(spark.createDataFrame([(1, "one " + "la di da " * 100_000 + "end")], SCHEMA)).head()
    assert row["n_words"] == 300_002 and [tuple(r) for r in row["runs"]] == [(1, 300_000, 3)] and row["collapsed"] == "one la di da end"
    with pytest.raises(ValueError):
        tandem.runs_of_words(np.arange(5), shortest=4)
