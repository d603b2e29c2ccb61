"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from repolens.plans import all_queries, all_sql
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES = all_queries()
SQL = all_sql()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_listed():
    rows_only = {k for k in QUERIES if k not in SQL}
    assert not rows_only


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    spd = QUERIES[name](spark, SF_SMALL).toPandas()
    dpd = duck.execute(SQL[name]).df()
    sc, sr = _rows(spd)
    dc, dr = _rows(dpd)
    assert sc == dc
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "overall" in df.columns
