import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup
from tessera.llm.words import Prefix

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every window."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), len(t) - len(kept), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    passage, base = line(20), line(40)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = line(30)
        elif kind == 1:
            text = line(5) + passage + line(5)
        elif kind == 2:
            text = base
        elif kind == 3:
            at = rng.randrange(len(base))
            text = base[:at] + "#" + base[at + 1 :]
        elif kind == 4:
            text = rng.choice(["a" * 150, "ab" * 70 + line(3), line(3)])
        else:
            text = passage[: rng.randint(10, len(passage))] + passage[rng.randint(0, 30) :]
        rows.append((i, text))
    return rows + [(None, base), (None, None), (7, None), (8, ""), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed, most_together", [(1, 2000), (2, 2), (3, 0)])
def test_as_brute_force(spark, seed, most_together):
    rows = made(seed)
    got = suffix_dedup.removal_report(spark.createDataFrame(rows, SCHEMA), length=40, gram=10, block=4, most_together=most_together).collect()
    assert Counter(tuple(r[:5]) for r in got) == brute(rows, 40)


def test_production_sizes_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(tuple(r[:5]) for r in suffix_dedup.removal_report(docs).collect()) == brute(rows, 400)


def test_empty_table_and_further_columns(spark):
    assert suffix_dedup.removal_report(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = "x y z " * 100
    docs = spark.createDataFrame([(1, twice, "s", 600, 5), (2, "kept", None, 4, 6), (3, None, "h", None, 7)], "doc_id long, text string, h string, n_chars long, spans int")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (got[1]["text"], got[1]["n_chars"], got[1]["h"], got[1]["spans"]) == ("", 0, "s", 5)
    assert (got[2]["text"], got[3]["text"], got[3]["n_chars"]) == ("kept", None, None)


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts, group = rng.integers(0, 2900, 500), np.sort(rng.integers(0, 9, 500))
    order = suffix_dedup.sort_suffixes(Prefix(data), data, starts, group, 40)
    key = [(g, bytes(data[s : s + 40])) for g, s in zip(group[order], starts[order])]
    assert sorted(order) == list(range(500)) and key == sorted(key)


def test_long_texts_come_in_pieces(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(150_000), text(120_000)
    assert len(shared) > 3 * suffix_dedup.PIECE
    rows = [(1, text(7) + shared + text(3)), (2, shared[5:]), (3, long), (4, long), (5, long[: len(long) // 2] + "#" + long[len(long) // 2 :])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.removal_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (len(shared) - 5, 1), 2: (len(shared) - 5, 1), 3: (len(long), 1), 4: (len(long), 1), 5: (len(long), 2)}
