"""Every query with SQL against DuckDB on the smallest tables."""

import functools
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module", autouse=True)
def stages_made_once():
    """The queries share their first stages here; each still runs its own operator."""
    names = ("stored", "sides", "scored")
    originals = {n: getattr(registry, n) for n in names}
    for n, f in originals.items():
        setattr(registry, n, functools.cache(f))
    yield
    for n, f in originals.items():
        setattr(registry, n, f)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def told(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(told(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(told(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["s1", "t", "p"]
