"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from factorlake.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, (bool, np.bool_, str)):
            return v
        return float(v) if isinstance(v, (int, float, np.number)) else str(v)[:10]

    return sorted(str(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, db, name):
    ours, theirs = Q.QUERIES[name](spark, sf).toPandas(), db.execute(Q.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_queries_without_sql_run(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).columns


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0
    assert set(Q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
