"""Every registered clustering query runs, and equals its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomvec.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "lineitem", "embeddings")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(columns).collect()), key=repr)
    assert rows
    if sql := catalog.oracle_sql().get(name):
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        assert rows == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
