"""Every catalogue query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lumenfold.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
