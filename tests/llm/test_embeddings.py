import numpy as np
import pytest

from tessera.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least):
    """vec_id -> (n_links, component_id) from all pairs."""
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= least
    np.fill_diagonal(near, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], 1 << 60).min(1))
        if (new == comp).all():
            break
        comp = new
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), comp)}


def made(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    v = centres[rng.integers(0, 20, n)] + rng.standard_normal((n, d)) * rng.choice([0.0, 0.02, 0.15, 0.5], n)[:, None]
    return [(i * 3 + 1, [float(x) for x in row], 0) for i, row in enumerate(v)]


@pytest.mark.parametrize("block", [1000, 7])
def test_recall_and_exact_links(spark, block):
    rows = made(1)
    want = brute(rows, 0.95)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, pivots=32).collect()}
    assert set(got) == set(want)
    links, found = sum(n for n, _ in want.values()), sum(r["n_links"] for r in got.values())
    assert 0.97 * links <= found <= links and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_blocks_change_nothing(spark):
    df = spark.createDataFrame(made(2), SCHEMA)
    whole, cut = ({tuple(r) for r in embeddings.near_duplicates(df, block=b, pivots=32).collect()} for b in (1000, 5))
    assert whole == cut


def test_odd_vectors_link_with_nothing(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.001], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [float("inf"), 0.0], 0), (8, [1.0, None], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [0.0, 1.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(2, 1, True), (2, 1, False), (2, 1, False)]
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, False)
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_length_is_compared_within_itself(spark):
    long, short = made(4, n=120, d=16), [(i + 1, v, l) for i, v, l in made(5, n=60, d=9)]
    want = brute(long, 0.95) | brute(short, 0.95)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(long + short, SCHEMA), pivots=12).collect()}
    assert sum(n for n, _ in want.values()) > 100 and sum(got[i][0] for i in want) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    with pytest.raises(ValueError):
        embeddings.near_duplicates(spark.createDataFrame([(i, [1.0] * (i + 1), 0) for i in range(101)], SCHEMA))


def test_recall_at_production_parameters(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, r = unit(rng.standard_normal((4000, 64))), rng.standard_normal((2000, 64))
    r = unit(r - (r * a[:2000]).sum(1, keepdims=True) * a[:2000])
    cosine = rng.uniform(0.9505, 0.99, 2000)[:, None]
    v = np.concatenate([a, cosine * a[:2000] + np.sqrt(1 - cosine**2) * r]).astype(np.float32)
    rows = [(i, [float(x) for x in y], 0) for i, y in enumerate(v)]
    want = brute(rows, 0.95)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = sum(n for n, _ in want.values())
    assert links >= 4000 and 0.97 * links <= sum(got.values()) <= links
    assert embeddings.pivots_for(10**5) == 256 and embeddings.pivots_for(10**7) == 1415


@pytest.mark.parametrize("d", [16, 64])
@pytest.mark.parametrize("pivots", [1024, 4096])
def test_near_pairs_share_lists_at_many_pivots(spark, d, pivots):
    """Planted pairs at a cosine of 0.951 among as many pivots as large tables have: at least 95 % meet in a list."""
    rng = np.random.default_rng(d + pivots)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, r = unit(rng.standard_normal((1500, d))), rng.standard_normal((1500, d))
    r = unit(r - (r * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * r
    rest = unit(rng.standard_normal((pivots + 200, d)))
    rows = [(i, 1, x.tolist()) for i, x in enumerate(np.concatenate([a, b, rest]))]
    df = spark.createDataFrame(rows, "cls long, n long, v array<double>")
    chosen = embeddings.choose_pivots(df, pivots, pivots + 1000)
    lists = embeddings.index(df.where("cls < 3000"), {d: chosen}, None).select("list", (embeddings.F.col("cls") % 1500).alias("pair"), "cls")
    met = lists.groupBy("list", "pair").agg(embeddings.F.countDistinct("cls").alias("n")).where("n = 2").select("pair").distinct().count()
    assert len(chosen) == pivots and met >= 0.95 * 1500


def test_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 5, "a", [1]), (2, [1.0, 0.01], 6, "b", [2])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, cls string, v array<int>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 1, 1), (2, 1, 1)]
