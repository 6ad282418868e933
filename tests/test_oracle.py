"""Every registered query that has SQL gives the same rows as DuckDB."""

import decimal

import duckdb
import pytest

from hushframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert ours == theirs


def test_every_query_without_sql_runs(spark, sf):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, sf).count() >= 0, name
