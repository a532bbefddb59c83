"""Every query with an SQL twin gives DuckDB's rows on the smallest tables; the others compute rows."""

import glob
import math
import os

import pytest

from touchline.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    if not glob.glob(f"{FOLDER}/*.parquet"):
        pytest.skip("no tables")
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.5g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert got.collect()
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(v) for v in r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
