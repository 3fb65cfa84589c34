"""Every registered query with an oracle gives the rows that DuckDB gives for its SQL."""

import decimal
import math
import os

import pytest

from tessera import plans

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_as_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(plans.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows_without_oracle(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0

