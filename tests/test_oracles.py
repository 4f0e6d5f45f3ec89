"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillstone.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, float):
        return f"{x:.6f}"
    return str(x)[:10] if hasattr(x, "year") else f"{float(x):.6f}" if hasattr(x, "dtype") and x.dtype.kind in "iuf" else f"{x:.6f}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def rows(d):
    return sorted(tuple(plain(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
