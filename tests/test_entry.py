"""Queries against their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from velum import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    mine = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    got = con.execute(oracles.SQL[name])
    names = [d[0] for d in got.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert mine == sorted(tuple(shown(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
