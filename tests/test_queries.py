"""Every query with SQL gives the rows that DuckDB gives; the others hold their invariants."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from panelquant.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    found = entry.queries()[name](spark, sf_dir)
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(result.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(result.columns, result.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 6
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) <= set(entry.queries())
