"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest
from lineaspark.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries()[name](spark, DIR)
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
