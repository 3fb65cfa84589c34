import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import test_suffix_dedup

import corpus_pipeline
from tessera.llm import passages, queries
from tessera.llm.scratch import Scratch
from tessera.llm.words import text_bytes, words_of

SCHEMA = "doc_id long, text string"


def brute(rows, documents, words):
    """doc_id: bytes under windows of words that so many documents share."""
    where, places = defaultdict(set), defaultdict(list)
    for doc, text in rows:
        found = [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())]
        for i in range(len(found) - words + 1):
            window = tuple(f[0] for f in found[i : i + words])
            where[window].add((doc, text))
            places[doc, text].append((window, found[i][1], found[i + words - 1][2]))
    out = defaultdict(set)
    for key, windows in places.items():
        for window, s, stop in windows:
            if len(where[window]) >= documents:
                out[key[0]].update(range(s, stop))
    return dict(out)


def spans(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = passages.shared_passages(docs, Scratch(spark, "test"), **sizes).collect()
    assert len({(r["did"], r["h"], r["s"]) for r in found}) == len(found)
    out = defaultdict(set)
    for r in found:
        out[r["did"]].update(range(r["s"], r["stop"]))
    return dict(out)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß7") for _ in range(rng.randint(1, 5)))
    text = lambda k: "".join(word() + rng.choice([" ", "\n", ", ", ". ", "-"]) for _ in range(k))
    shared = [text(rng.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in range(1, 60):
        parts = [text(rng.randint(0, 20)) for _ in range(3)]
        parts.insert(1, rng.choice(shared).upper() if i % 7 == 0 else rng.choice(shared))
        if i % 5 == 0:
            parts += [rng.choice(shared)[rng.randint(0, 20) :], "x y " * rng.randint(0, 15)]
        rows.append((i, "".join(parts)))
    return rows + [(60, None), (61, ""), (62, "!!"), (63, rows[2][1]), (64, rows[2][1]), (3, rows[2][1])]


@pytest.mark.parametrize("seed, documents, words", [(1, 2, 12), (2, 3, 12), (3, 5, 9)])
def test_as_brute_force(spark, seed, documents, words):
    rows = made(seed)
    want = brute(rows, documents, words)
    assert want and spans(spark, rows, documents=documents, words=words, gram=4) == want


def test_long_texts_come_in_parts():
    data, offsets = text_bytes(pa.array([t for _, t in made(5)], pa.string()))
    w = words_of(data, offsets)

    def windows(together):
        return [(p, key) for first, many, keys in passages.anchors(w, 12, 4, together) for f, n, key in zip(first, many, keys) for p in range(f, f + n)]

    assert windows(7) == windows(100) == windows(1 << 17) and len(windows(7)) > 500
    spelt, begin = passages.joined(w, 5, 9)
    assert bytes(spelt).split(b" ") == [bytes(w.data[w.start[i] : w.end[i]]) for i in range(5, 9)] + [b""] and begin[-1] == len(spelt)


def test_nothing_shared(spark):
    assert spans(spark, [], documents=2) == {} and spans(spark, [(1, "a b " * 200)], documents=2) == {}


def test_stage_cuts_short_passages_of_many_words(spark):
    """A passage of 60 words under 400 bytes in three documents goes; one in two documents and one of 50 words stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda k: " ".join(word() for _ in range(k))
    common, rare, short = text(60), text(60), text(50)
    assert len(common) < 400
    own = [(text(30), text(30)) for _ in range(7)]
    inside = [common, common, common, rare, rare, short, short]
    rows = [(i, f"{a} {p} {b}") for i, ((a, b), p) in enumerate(zip(own, inside))] + [(7, f"{text(9)} {short}")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert [got[i].split() for i in range(3)] == [f"{a} {b}".split() for a, b in own[:3]]
    assert all(got[i] == t for i, t in rows[3:])


def test_op1_counts_passages_beside_the_bytes_it_removes(spark, tmp_path):
    """A passage of 60 words under 400 bytes that two or three documents share is counted, one of 50 words or in one document is not; the removal is that of strings of 400 bytes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda k: " ".join(word() for _ in range(k))
    common, rare, short, long, own = text(60), text(60), text(50), text(90), text(60)
    assert len(common) < 400 < len(long)
    inside = [common, common, common, rare, rare, short, short, long, long, f"{own} {text(5)} {own}", f"{rare} {text(5)} {common}"]
    rows = [(i, f"{text(30)} {p} {text(30)}") for i, p in enumerate(inside)] + [(11, None), (12, ""), (None, text(70)), (13, rare), (13, rare)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_suffix_dedup(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[:5]) for r in got) == test_suffix_dedup.brute(rows, 400)
    counts = {r["doc_id"]: (r["n_passages"], r["n_passage_bytes"], r["passage_documents"]) for r in got}
    want = {i: (1, 359, 4) for i in (0, 1, 2)} | {i: (1, 359, 4) for i in (3, 4, 13)} | {i: (1, 539, 2) for i in (7, 8)} | {10: (2, 718, 4)}
    assert counts == {i: want.get(i, (0, 0, 0)) for i, _ in rows}
    assert {r["doc_id"] for r in got if r["n_removed"]} == {7, 8}
