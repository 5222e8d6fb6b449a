"""Registered raster queries against their SQL, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tilestrata import command_queries, document_queries, oracles, path_queries, wide_queries
from tilestrata import queries as raster_queries

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql() | command_queries.oracle_sql() | wide_queries.oracle_sql() | document_queries.oracle_sql() | path_queries.oracle_sql()
QUERIES = raster_queries.queries() | command_queries.queries() | wide_queries.queries() | document_queries.queries() | path_queries.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 4) + 0.0 if isinstance(v, (int, float)) else v
    return Counter(tuple(fix(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())
