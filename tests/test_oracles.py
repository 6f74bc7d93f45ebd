"""Every registered query against its DuckDB oracle on sf0.001 (exact)."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001
from scorecard.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(ORACLES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["label", "score", "n_models"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    s_cols = df.columns
    rel = con.sql(ORACLES[name])
    d_cols = rel.columns
    assert sorted(s_cols) == sorted(d_cols)
    order = sorted(s_cols)
    s = collections.Counter(tuple(r[c] for c in order) for r in df.collect())
    d_rows = rel.fetchall()
    d = collections.Counter(tuple(r[d_cols.index(c)] for c in order) for r in d_rows)
    assert s == d
