"""Registered queries with oracle SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from repolens.llm import queries

SF = "/root/testdata/sf0.001"


def norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted((tuple(map(norm, r)) for r in df[cols].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
