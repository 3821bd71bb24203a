"""Every registered query against its oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(entry_points.QUERIES) == set(entry_points.ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(entry_points.QUERIES))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, SF)
    columns = sorted(result.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in result.collect())
    expected = duck.execute(entry_points.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(expected.description)}
    assert sorted(at) == columns
    assert got == sorted(tuple(repr(r[at[c]]) for c in columns) for r in expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    assert len(entry_points.entry(spark).columns) == 21
