"""Every registered query with a SQL twin equals DuckDB on the same Parquet tables (sf0.001),
and every rows-only query runs; schema names match."""

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry
from tools.oracle_check import TABLES, digest

from labelflow.plans import REGISTRY

# the corpus queries have their own parity and brute-force tests in tests/llm
SQL = {k: v for k, v in entry.oracle_sql().items() if k in REGISTRY}
QUERIES = {k: v for k, v in entry.queries().items() if k in REGISTRY}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_key_is_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(sdf.columns, rows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["accuracy"] <= 1.0
