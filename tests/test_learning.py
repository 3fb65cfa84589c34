"""Clusters, margins and their calibration on planted data and against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, margins, tables


def planted(k, n=60, d=6, seed=0, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((k, d)) * 3
    label = rng.integers(0, k, n * k)
    return centers[label] + spread * rng.standard_normal((n * k, d)), label


@pytest.mark.parametrize("k", [2, 3, 4])
def test_planted_clusters_come_back(spark, k):
    v, label = planted(k, seed=k)
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(9999, None)]
    found, tried = clusters.best_clusters(spark.createDataFrame(rows, "id long, v array<double>").repartition(5), "id", "v")
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert max(tried, key=lambda x: x[1])[0] == k and set(got) == set(range(len(v)))
    assert len({(int(label[i]), c) for i, c in got.items()}) == k
    sizes = np.bincount(list(got.values()))
    assert (np.diff(sizes) <= 0).all()


def test_inertia_falls_and_silhouette_is_exact(spark):
    v, _ = planted(4, 30, 3, seed=9, spread=1.5)
    df = spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], "id long, v array<double>").repartition(3)
    centers, inertia = clusters.k_means(df, 4)
    assert len(inertia) > 1 and (np.diff(inertia) < 0).all()
    index = ((v[:, None] - centers) ** 2).sum(2).argmin(1)
    far = ((v[:, None] - v) ** 2).sum(2)
    want = []
    for i in range(len(v)):
        a = far[i][index == index[i]].sum() / max((index == index[i]).sum() - 1, 1)
        b = min(far[i][index == c].mean() for c in range(4) if c != index[i] and (index == c).any())
        want.append((b - a) / max(a, b) if (index == index[i]).sum() > 1 else 0.0)
    assert clusters.silhouette(df, centers) == pytest.approx(np.mean(want))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert clusters.k_means(same, 3)[0].tolist() == [[1.0, 2.0]] and clusters.silhouette(same, np.array([[1.0, 2.0]])) == 0.0


def test_pooled_neighbours_as_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 9, 30):
        w, m = rng.integers(1, 5, n), rng.random(n)
        got = margins.pool_adjacent(w, m)
        assert (np.diff(got) >= 0).all()
        # the largest of all means that begin at or before a place, least over those that end at or after it
        want = [max(min(np.average(m[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert got == pytest.approx(want)


def test_margins_separate_and_probabilities_rise(spark):
    rng = np.random.default_rng(1)
    words = lambda good: " ".join(rng.choice(["sun", "sea", "sky"] if good else ["mud", "rot", "rust"], 3)) + " " + " ".join(rng.choice(["a", "b", "c", "d"], 6))
    rows = [(i, words(i % 3 == 0), 1 if i % 3 == 0 else -1) for i in range(240)] + [(1000, None, -1), (1001, "", -1)]
    df = spark.createDataFrame(rows, "id long, text string, label int").withColumn("cells", margins.hashed_words(F.col("text")))
    weights = margins.train_margins(df.where("id < 200"))
    scored = margins.score_margins(df, weights)
    held = scored.where("id between 200 and 999").collect()
    assert all((r["margin"] > 0) == (r["label"] > 0) for r in held)
    steps = margins.calibrate(scored)
    assert [p for _, p in steps] == sorted(p for _, p in steps) and steps[0][1] == 0.0 and steps[-1][1] == 1.0
    got = scored.select("label", margins.probability(F.col("margin"), steps).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in got) and np.mean([r["p"] for r in got if r["label"] > 0]) > 0.95
    assert not margins.train_margins(df.where("label > 0")).any()


def test_margins_below_every_step_have_the_lowest_probability(spark):
    df = spark.createDataFrame([(-9.0,), (-0.5,), (0.2,), (7.0,)], "margin double").orderBy("margin")
    assert [r["p"] for r in df.select(margins.probability(F.col("margin"), [(-1.0, 0.1), (0.0, 0.4), (1.0, 0.9)]).alias("p")).collect()] == [0.1, 0.1, 0.4, 0.9]
    assert [r["p"] for r in df.select(margins.probability(F.col("margin"), [(0.0, 0.3)]).alias("p")).collect()] == [0.3] * 4


def test_votes_of_two_engines(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 0), (2, 1, 4), (4, 1, 12)], "page int, k int, n int")
    b = spark.createDataFrame([(1, 1, 12), (1, 2, 13), (1, 5, 0), (3, 7, 9), (4, 1, 10)], "page int, k int, n int")
    got = {(r["page"], r["place"]): (r["engine"], r["verdict"], r["k"], r["n"]) for r in tables.zip_and_vote(a, b, "page", "k", "n").collect()}
    assert got == {(1, 1): ("first", "confirmed", 1, 10), (1, 2): ("second", "larger", 2, 13), (1, 3): ("first", "confirmed", 3, 0), (2, 1): ("first", "solo", 1, 4), (3, 1): ("second", "solo", 7, 9), (4, 1): ("first", "confirmed", 1, 12)}


def test_repaired_blocks(spark):
    lines = ["Quarterly report", "The company sold more units", " than in the whole year before.", "12.5 13.0 14", "x", "The company sold more units", "Outlook {watermark} is good and goes on", "- 1 -"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "id int, line int, text string")
    got = [(r["text"], r["lines"]) for r in tables.repair_blocks(df, "id", "line", "text").orderBy("block").collect()]
    assert got == [("Quarterly report", 1), ("The company sold more unitsthan in the whole year before.", 2), ("Outlook is good and goes on", 1)]


def test_repaired_blocks_are_shuffled_once(spark):
    """Lines go to their page once; the first of equal beginnings stays; only white space at the very ends goes, also before a line separator."""
    same = "y" * tables.SAME
    lines = ["A line that is not ended \u2028", same + " first.", "\t\x0b A line of\u3000its\u00a0own. \r", same + " second."]
    df = spark.createDataFrame([(p, i, t) for p in (1, None) for i, t in enumerate(lines)], "id int, line int, text string").repartition(3)
    got = tables.repair_blocks(df, "id", "line", "text")
    want = [("A line that is not ended \u2028" + same + " first.", 2), ("A line of its own.", 1)]
    assert sorted((r["id"] or 0, r["block"], r["text"], r["lines"]) for r in got.collect()) == [(p, k + 1, *w) for p in (0, 1) for k, w in enumerate(want)]
    plan = tables.repair_blocks(spark.range(3).selectExpr("id", "1 AS line", "'x' AS text"), "id", "line", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
