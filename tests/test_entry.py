"""The registered queries: names, a smoke run, and SQL for the same rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinetra import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))
