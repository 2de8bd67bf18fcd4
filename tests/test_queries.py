"""Every query that has SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from quillon.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cells(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([None if r[i] is None else float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df, expected = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert cells(df.collect(), df.columns) == cells(expected.fetchall(), expected.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
