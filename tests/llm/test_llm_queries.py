"""Every llm query runs on the smallest tables; those with SQL give the same rows."""

import os

import duckdb
import pytest

from treeline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
    if name in queries.SQL:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
        other = c.execute(queries.SQL[name]).df()[df.columns]
        assert sorted(map(tuple, rows)) == sorted(other.itertuples(index=False, name=None))
