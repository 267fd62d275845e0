import glob
import importlib
import os

import duckdb
import pytest

from palimpsest import queries


def same(value):
    return "null" if value is None or value != value else repr(int(value)) if isinstance(value, float) and value == int(value) else str(value)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(same, r)) for r in want.fetchall())
    assert sorted(tuple(same(r[c]) for c in columns) for r in got.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_others_have_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
