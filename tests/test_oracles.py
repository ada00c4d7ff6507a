"""Every query with SQL against DuckDB, on the tables at sf0.001; the order of rows does not count."""

import os

import duckdb
import pytest

from rillwork.option_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    mine = QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    keys = [c for c in ("r", "c", "id", "basin_id", "classification", "n", "vid", "tid", "link_id", "row_off", "col_off", "inside", "problem") if c in mine.columns]
    mine, theirs = (x.sort_values(keys).reset_index(drop=True)[sorted(mine.columns)] for x in (mine, theirs))
    assert len(mine) == len(theirs)
    for c in mine.columns:
        a, b = mine[c], theirs[c]
        assert (a.isna() == b.isna()).all(), c
        if a.dtype.kind == "f":
            assert ((a - b).abs().fillna(0) <= 2e-6 * (1 + b.abs().fillna(0))).all(), c
        else:
            assert (a.fillna(-1) == b.fillna(-1)).all(), c
