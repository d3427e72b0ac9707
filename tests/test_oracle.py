"""Every registered query against its DuckDB oracle (sorted rows, columns by name)."""

import duckdb
import pytest

from tagtide.plans.catalog import QUERIES
from tagtide.plans.oracle import oracle_sql

from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


def _key(row):
    return [(True, 0) if v is None else (False, v) for v in row]


def test_every_query_is_registered_in_the_entry():
    import __spark_entry__ as e
    assert set(e.queries()) >= set(QUERIES)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    idx = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=_key)
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) >= {"lang", "precision", "recall", "f1"}
