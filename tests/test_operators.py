"""Operators on small fixtures, with the odd cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric, text
from tessera.operators import bom, process, recursive, reconcile, significance
from tessera.operators import windows as w
from tessera.sources import readers, sinks

DAY = dt.date(2026, 6, 1)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).head()["y"]


@pytest.mark.parametrize("raw, want", [("(1,234)", -1234.0), ("12%", 12.0), ("N/A", None), ("1O", 10.0), ("", None), (None, None), ("+5", 5.0), ("abc", None)])
def test_ocr_numbers(spark, raw, want):
    assert one(spark, numeric.clean_ocr_number(F.col("x")), raw) == want


@pytest.mark.parametrize("raw, want", [("Re: Fwd：[x]  Hello  World", "hello world"), ("plain", "plain"), (None, None), ("", "")])
def test_subject(spark, raw, want):
    assert one(spark, text.subject_key(F.col("x")), raw) == want


def test_text_functions(spark):
    assert one(spark, text.half_width(F.col("x")), "ＶＩＡ０１６２") == "VIA0162"
    assert one(spark, text.sentences(F.col("x")), "Pi is 3.14. Yes!\n No? ") == ["Pi is 3.14.", "Yes!", "No?"]
    assert one(spark, text.without_reply_chain(F.col("x")), "hello\n-- \nsig") == "hello"
    assert one(spark, text.without_reply_chain(F.col("x")), "no mark") == "no mark"
    assert one(spark, text.case_id(F.col("x")), "see case 7") == "CASE-0007" and one(spark, text.case_id(F.col("x")), "none") is None
    assert one(spark, text.script_share(F.col("x")), "看一下 dashboard") == "mixed" and one(spark, text.script_share(F.col("x")), "12") is None
    assert [one(spark, text.parse_date(F.col("x")), d) for d in ("2024-03-05", "05.03.2024", "20240305", "x", None)] == [dt.date(2024, 3, 5)] * 3 + [None] * 2


def test_cost_structure(spark):
    got = one(spark, numeric.cost_structure(F.lit(60.0), F.lit(1000.0), F.lit(100.0), F.lit(50.0)), "a")
    assert (got["unit_contribution"], got["breakeven_units"]) == (40.0, 25.0)


def test_process_fixture(spark):
    day = lambda d: dt.datetime(2026, 6, d)
    rows = [("A", a, day(d), i) for i, (a, d) in enumerate([("EVT", 1), ("DVT", 5), ("DVT", 9), ("PVT", 14), ("MP", 20)])] + [("B", "EVT", day(2), 0), ("B", "PVT", day(6), 1)]
    log = spark.createDataFrame(rows, "case string, activity string, ts timestamp, seq int")
    rework = {r["activity"]: r for r in process.rework(log).collect()}
    assert rework["DVT"]["self_loops"] == 1 and rework["DVT"]["revisits"] == 1
    checked = {r["case"]: (r["backward"], r["skips"]) for r in process.conformance(log, ["EVT", "DVT", "PVT", "MP"]).collect()}
    assert checked == {"A": (0, 0), "B": (0, 1)}
    assert {(r["source"], r["target"]): r["n"] for r in process.directly_follows(log).collect()}[("DVT", "DVT")] == 1
    assert process.directly_follows(log.limit(0)).count() == 0


def test_bom_fixture_and_cycles(spark):
    edges = spark.createDataFrame([("A", "B", 2.0), ("A", "C", 3.0), ("B", "D", 4.0), ("D", "A", 1.0)], "parent string, child string, qty double")
    got = {(r["item"], r["level"]): (r["qty"], r["cycle"]) for r in bom.explode(edges, spark.createDataFrame([("A",)], "top string")).collect()}
    assert got[("D", 2)] == (8.0, False) and got[("A", 3)] == (8.0, True) and len(got) == 4
    assert [r["used_in"] for r in bom.where_used(edges.where("parent <> 'D'"), spark.createDataFrame([("D",)], "item string")).orderBy("level").collect()] == ["B", "A"]


def test_deep_and_wide_bills_are_not_cut(spark):
    chain = spark.range(30).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"), F.lit(1.0).alias("qty"))
    top = spark.createDataFrame([(0,)], "top long")
    assert sorted(r["level"] for r in bom.explode(chain, top).collect()) == list(range(1, 31))
    assert bom.where_used(chain, spark.createDataFrame([(30,)], "item long")).count() == 30
    assert [r["top"] for r in bom.roots(chain).collect()] == [0]
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        bom.explode(chain, top, most_levels=10).collect()
    wide = spark.range(1, 1_100_001).select(F.lit(0).cast("long").alias("parent"), F.col("id").alias("child"), F.lit(1.0).alias("qty"))
    assert bom.explode(wide, top).count() == 1_100_000


def test_bills_pass_no_edges_through_the_driver(spark):
    edges = spark.range(1, 40).select(F.expr("id div 2").alias("parent"), F.col("id").alias("child"), F.lit(1.0).alias("qty"))
    tree = bom.explode(edges, bom.roots(edges))
    costs = edges.select(F.col("child").alias("item"), F.lit(1.0).alias("cost"))
    for df in (tree, bom.roll_up_cost(tree, costs, edges), bom.where_used(edges, costs)):
        plan = df._jdf.queryExecution()
        assert "strategy=merge" in plan.analyzed().toString() and "Broadcast" not in plan.executedPlan().toString()
    assert bom.roll_up_cost(tree, costs, edges).head()["cost"] == 20.0  # leaves 20 to 39


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 5.0), (5, 0.0)], "k int, value double")
    b = spark.createDataFrame([(1, 101.0), (2, 100000.0), (4, 5.0), (5, 0.0)], "k int, value double")
    got = reconcile.compare(a, b, ["k"])
    assert {r["k"]: r["verdict"] for r in got.collect()} == {1: "MATCH", 2: "MISMATCH", 3: "FIRST_ONLY", 4: "SECOND_ONLY", 5: "MATCH"}
    assert got.where("k = 2").select(reconcile.mismatch_reason(F.col("first"), F.col("second"))).head()[0] == "UNIT_1000"


def panel(spark, values):
    rows = [("T", DAY + dt.timedelta(i), *(float(v) if v is not None else None for v in (x, x, x, x)), 1.0) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, d date, open double, high double, low double, close double, volume double")


def test_windows_with_nulls(spark):
    df = panel(spark, [1, None, 3, 4, 5])
    got = [r["y"] for r in df.select("d", w.sma("close", 3).alias("y")).orderBy("d").collect()]
    assert got == [None, None, None, None, 4.0]
    assert [r["y"] for r in df.select("d", w.forward_fill("close").alias("y")).orderBy("d").collect()] == [1, 1, 3, 4, 5]
    assert [r["y"] for r in df.select("d", w.clipped(w.rolling_z("close", 5, 2), 0.1).alias("y")).orderBy("d").collect()][0] is None


def test_recursive_indicators_as_pandas(spark):
    x = np.random.default_rng(1).uniform(10, 20, 60)
    got = recursive.indicators(panel(spark, x)).orderBy("d").toPandas()
    assert np.allclose(got["ema"], pd.Series(x).ewm(span=12, adjust=False).mean())
    assert got["rsi"].iloc[1:].dropna().between(0, 100).all() and recursive.indicators(panel(spark, []) if False else panel(spark, [1.0]).limit(0)).count() == 0


def test_pivots(spark):
    kinds = [r["kind"] for r in recursive.pivots(panel(spark, [10, 12, 9, 8, 11, 7]), 0.2).orderBy("d").collect()]
    assert kinds == ["H", "L", "H"]


def test_significance():
    rng = np.random.default_rng(3)
    good, noise = rng.normal(0.01, 0.01, 500), rng.normal(0, 0.01, 500)
    assert significance.bootstrap_p(good) < 0.01 < significance.bootstrap_p(noise) and significance.deflated_sharpe(good) > 0.99
    assert significance.sharpe(good[:2]) == 0 and significance.bootstrap_p(good[:3]) == 1.0


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", dt.date(2023, 5, 1)), (2, None, dt.date(2024, 5, 1))], "k int, v string, d date")
    assert dict(sinks.fan_out(df, str(tmp_path / "out"))) == {"parquet": 2, "csv": 2, "json": 2}
    got, why = readers.first_source(spark, [(str(tmp_path / "none"), "parquet"), (str(tmp_path / "out/csv"), "csv")])
    assert got.count() == 2 and len(why) == 1
    sinks.save_by_year(None, df, ["k"], "d", str(tmp_path / "y"))
    snapshot = spark.createDataFrame(spark.read.parquet(str(tmp_path / "y")).drop("year").collect(), df.schema)
    sinks.save_by_year(snapshot, spark.createDataFrame([(1, "new", dt.date(2023, 5, 1))], df.schema), ["k"], "d", str(tmp_path / "y"))
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "y")).collect()} == {(1, "new"), (2, None)}
    assert readers.canonical(spark.createDataFrame([(1, 2)], "Symbol int, `收盤` int"), ["ticker", "close", "volume"]).columns == ["ticker", "close", "volume"]
    assert [readers.group_members(spark, t).count() for t in ({"g": ["a", "b"]}, [{"name": "g", "members": ["a"]}], [["g", "a", "b"]], ["a", "b", "c"])] == [2, 1, 2, 3]


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "n")], "k int, v string")
    assert {r["k"]: (r["action"], r["v"]) for r in sinks.upsert(old, new, "k").collect()} == {1: ("stale", "a"), 2: ("updated", "x"), 3: ("unchanged", None), 4: ("added", "n")}
    assert sinks.unseen(spark.createDataFrame([], "record_hash string"), new.unionByName(new), ["k", "v"]).count() == 3


def test_places_of_a_hot_group(spark):
    from tessera.operators import ranks

    rows = [("hot", float(i % 7), i) for i in range(500)] + [("cold", 1.0, 1000), ("cold", None, 1001), (None, 2.0, 1002)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = ranks.positions(df, "g", "v", "i").collect()
    for g in ("hot", "cold", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert [r["i"] for r in own] == [r[2] for r in want] and [r["place"] for r in own] == list(range(len(want))) and {r["size"] for r in own} <= {len(want)}
    q = {r["g"]: r["m"] for r in ranks.quantiles(df, "g", "v", "i", {"m": 0.5}).collect()}
    assert q == {"hot": 3.0, "cold": 1.0, None: 2.0}
    assert ranks.positions(df.limit(0), "g", "v", "i").count() == 0


def test_cycles(spark):
    from tessera.operators import market

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7), (None, 1), (8, 9), (9, 8), (9, 10)], "task int, pred int")
    assert {r["task"] for r in market.on_cycles(edges).collect()} == {1, 2, 3, 5, 8, 9}
    assert market.on_cycles(edges.limit(0)).count() == 0
