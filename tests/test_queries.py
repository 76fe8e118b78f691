"""Every core query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from treeline.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_same_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    assert rows(ours) == rows(duck.execute(registry.sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_runs_without_sql(spark, name):
    registry.queries()[name](spark, DATA).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
