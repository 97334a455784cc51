"""Every registered query with SQL against DuckDB on the small tables; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sketchloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(QUERIES) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_evaluation_takes_every_order(spark):
    from sketchloom.queries import _workload

    sf = "/root/testdata/sf0.01"
    w = _workload(spark, sf)
    assert sum(map(len, w.stages)) == spark.read.parquet(f"{sf}/orders.parquet").count() and len(w.absent) == 96
