"""Every query of the library against another engine, over whole tables of the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from veilscan.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in os.listdir(SMALL):
        table, _, kind = name.rpartition(".")
        if kind == "parquet":
            connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{name}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, engine, name):
    df = catalogue.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = _rows(df.select(*columns).collect())
    if name not in catalogue.oracle_sql():
        assert mine
        return
    theirs = engine.sql(catalogue.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    order = [theirs.columns.index(c) for c in columns]
    assert mine == _rows(tuple(r[i] for i in order) for r in theirs.fetchall())
