"""Every wayfinding query against its SQL."""

import os

import duckdb
import pytest

from waymark.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    flat = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(flat(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, db, name):
    ours = QUERIES[name](spark, DATA)
    theirs = db.execute(SQL[name])
    columns = [x[0] for x in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, map(tuple, ours.collect())) == rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_queries_that_sql_cannot_express_have_rows(spark, name):
    """Their kernels have tests of their own, by cases, brute force and streams."""
    assert QUERIES[name](spark, DATA).count() > 0
