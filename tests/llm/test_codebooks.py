import hashlib
import math

import numpy as np
import pytest

from tessera.llm import codebooks, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
duckdb = pytest.importorskip("duckdb")


def brute(rows):
    """(vec_id, code, error, label_error) and the codebooks, with Python integers and all distances."""
    good = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    step = len(first[0][1]) // 8
    parts = lambda v: [v[p * step : (p + 1) * step] for p in range(8)]
    books = [[parts(v)[p] for _, v, _ in first] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            mine = {}
            for _, v, _ in good:
                mine.setdefault(near(parts(v)[p], books[p])[1], []).append(parts(v)[p])
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, k in good:
        best = [near(x, books[p]) for p, x in enumerate(parts(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), k))
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == k)) for i, c, e, k in out), key=str), books


def made(n=300, d=24, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.standard_normal((n, d)) * 3) / 8  # few values, so that distances are often equal
    rows = [(int(i), [float(x) for x in y], int(k) if k < 4 else None) for i, y, k in zip(rng.permutation(n) * 3 + 5, v, rng.integers(0, 5, n))]
    return rows + rows[:3]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_codes_as_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", bound)
    nan = float("nan")
    rows = made() + [(1, None, 0), (2, [nan] + [0.0] * 23, 0), (3, [None] + [0.0] * 23, 1), (4, [float("-inf")] + [0.0] * 23, None), (None, [0.5] * 24, 1), (None, [0.25] * 24, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, error int").repartition(5)
    got, books = codebooks.compress(frame)
    want, entries = brute(rows)
    assert books.tolist() == entries
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == want


def test_tree_finds_lowest_of_equal_entries():
    rng = np.random.default_rng(2)
    for d in (0, 1, 2, 5):
        for n in (1, 2, 3, 7, 16):
            book, points = rng.integers(-3, 4, (n, d)), rng.integers(-4, 5, (500, d))
            far = ((points[:, None] - book[None]) ** 2).sum(2)
            index, best = codebooks.KdTree(book).nearest(points)
            assert (index == far.argmin(1)).all() and (best == far.min(1)).all()
    book = np.array([[0, 0], [2, 0], [0, 2], [2, 2], [0, 0]])
    assert codebooks.KdTree(book).nearest(np.array([[1, 1], [0, 0], [2, 1]]))[0].tolist() == [0, 0, 1]


def test_few_rows_empty_tables_and_errors(spark):
    rows = [(9, [float(i)] * 8, None) for i in range(3)]
    got, _ = codebooks.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["code"] for r in got.collect()) == ["00" * 8, "01" * 8, "02" * 8]
    got, books = codebooks.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error", "label_error"] and codebooks.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [3e38] * 8, 1)]):
        with pytest.raises(ValueError):
            codebooks.compress(spark.createDataFrame(bad, SCHEMA))
    got, _ = codebooks.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA))
    assert [tuple(r) for r in got.orderBy("vec_id").collect()] == [(1, 1, "00" * 8, 0, 0), (2, None, "00" * 8, 0, 0)]


def test_query_as_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = queries.op13_vector_codes(spark, folder)
    want = con.sql(codebooks.oracle_sql())
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.select(*got.columns).fetchall()))
