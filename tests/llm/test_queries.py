"""The problem queries that SQL can say, against it, on the smallest tables."""

import os
from collections import Counter

import pytest

from leadloom.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    out = con.execute(oracle.SQL[name])
    names = [d[0] for d in out.description]
    assert got == Counter(tuple(r[names.index(c)] for c in cols) for r in out.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() >= 0
