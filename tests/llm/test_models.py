"""Trained operators: held-out accuracy, and what they do with odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import features, langid, quality, toxicity

FOLDER = "/root/testdata/sf0.1"
ODD = [(1, None, None, None, "a", 0.5), (2, "", "en", None, "b", 0.5), (3, "12 !!", "en", None, "c", 0.5), (None, "some plain words", None, None, None, None), (5, "the same text", "en", 1, "x", 1.0), (5, "the same text", "en", 1, "x", 1.0), (6, "word " * 300_000, "en", 0, "y", 1.0)]
SCHEMA = "doc_id long, text string, lang string, toxic int, margin string, score double"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def _held_out(spark, rows, column):
    want = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r[column] is not None}
    rows = [r for r in rows if r["held_out"] and r["doc_id"] in want]
    return rows, np.array([want[r["doc_id"]] for r in rows])


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"]) for r in got)
    rows, label = _held_out(spark, got, "toxic")
    said = np.array([r["predicted"] for r in rows])
    assert auc(np.array([r["score"] for r in rows]), label) > 0.95
    assert said[label == 1].mean() > 0.88 and said[label == 0].mean() < 0.01
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_toxicity_of_long_clean_texts(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels)
    rows = docs.join(labels.groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic"), "doc_id").where("text is not null").orderBy("doc_id").collect()
    clean = [r["text"] for r in rows if held(r["doc_id"]) and r["toxic"] == 0]
    toxic = [r["text"] for r in rows if held(r["doc_id"]) and r["toxic"] == 1]
    alone = model.score(model.margins(pa.array(clean))) >= 0.7
    assert alone.mean() < 0.005
    rng = np.random.default_rng(5)
    chosen = [rng.choice(len(clean), n, replace=False) for n in (20, 100, 200, 300) for _ in range(25)]
    joined = [" ".join(clean[i] for i in some) for some in chosen]
    said = model.score(model.margins(pa.array(joined))) >= 0.7
    holds = np.array([alone[some].any() for some in chosen])  # a text that is flagged by itself is flagged within others too; no other joined text may be
    assert said[~holds].mean() <= 0.01 and (~holds).sum() > 60
    clean = [t for t, x in zip(clean, alone) if not x]
    joined = [" ".join(rng.choice(np.array(clean, dtype=object), 20, replace=False)) for _ in range(2)]
    # a toxic text inside a long clean one is still found: its windows are scored by themselves
    alone = model.score(model.margins(pa.array(toxic))) >= 0.7
    inside = model.score(model.margins(pa.array([" ".join([joined[0], t, joined[1]]) for t in toxic]))) >= 0.7
    assert inside[alone].mean() > 0.9


def test_windows_hold_every_word():
    words = [f"w{i}" for i in range(23)]
    texts = ["", *[" ".join(words[:n]) for n in (1, 5, 9, 10, 11, 15, 23)], "!!"]
    (lo, hi, first, n, window, feature), = features.window_stems(pa.array(texts), 22, 5)
    last = np.r_[first[1:], max(first[-1], window.max()) + 1]
    whole = {(d, f) for _, _, doc, feat, _ in features.stems(pa.array(texts), 22) for d, f in zip(doc.tolist(), feat.tolist())}
    got = {(int(np.searchsorted(first, w, "right") - 1), f) for w, f in zip(window.tolist(), feature.tolist())}
    assert (lo, hi) == (0, len(texts)) and got == whole and (np.bincount(window) <= 10).all()
    assert (last - first).tolist() == n.tolist() == [1, 1, 1, 1, 1, 2, 2, 4, 1]


def test_toxicity_without_labels(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for labels in ([], [(2, 0), (None, 1)]):
        model = toxicity.train_toxicity(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score_toxicity(odd, model).collect()} == {0.0}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    row = lambda toxic: (np.unique(np.r_[rng.integers(0, 300, 20), 300 + rng.integers(0, 5, 3 if toxic else 0)]), None)
    texts = [(f, np.ones(len(f))) for f, _ in [row(True) for _ in range(100)]]
    other = [(f, np.ones(len(f))) for f, _ in [row(i % 5 == 0) for i in range(1000)]]
    w = toxicity.fit_nnpu(texts, other, 0.2, 512)
    margin = np.array([w[f].sum() for f, _ in other])
    assert auc(margin, np.array([i % 5 == 0 for i in range(1000)]).astype(int)) > 0.99


def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langid.predict_language(docs, langid.train_languages(docs)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(got) == docs.count() and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.95


def test_language_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    english = "the quick brown fox jumps over the lazy dog and then it rests for a while "
    learned = langid.train_languages(spark.createDataFrame([(i, english, "en") for i in range(9)] + [(i, "der schnelle braune Fuchs und ein fauler Hund", "de") for i in range(9, 15)], "doc_id long, text string, lang string"))
    got = langid.predict_language(odd, learned).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: str(r["doc_id"]))][:3] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.predict_language(odd, {}).collect()} == {"und"}
    assert langid.predict_language(odd.limit(0), learned).count() == 0 and langid.train_languages(odd.limit(0)) == {}


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.train_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    rows, label = _held_out(spark, got, "quality")
    assert len(got) == docs.count() and auc(np.array([r["expected_grade"] for r in rows]), label) > 0.9
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert quality.score_quality(odd, model).count() == len(ODD)
    none = quality.train_quality(odd, labels.limit(0))
    assert {(r["expected_grade"], r["tail_probability"]) for r in quality.score_quality(odd, none).collect()} == {(0.0, 1.0)}
    assert quality.score_quality(odd.limit(0), none).count() == 0


def test_grades_are_ordered():
    rng = np.random.default_rng(3)
    rank = rng.integers(0, 4, 800)
    rows = [(np.unique(np.r_[rng.integers(0, 100, 10), 100 + r * 3 + rng.integers(0, 3, 4)]), None) for r in rank]
    rows = [(f, np.ones(len(f))) for f, _ in rows]
    w, thresholds = quality.fit_ordinal(rows, rank, 4, 256)
    model = quality.QualityModel(w, thresholds, np.arange(4.0))
    x = np.array([(w[f] * np.log(2)).sum() / (np.log(2) * np.sqrt(len(f))) for f, _ in rows])
    grade, tail = model.grade(x)
    assert (np.diff(thresholds) > 0).all() and np.abs(grade - rank).mean() < 0.5 and auc(tail, (rank == 3).astype(int)) > 0.95
