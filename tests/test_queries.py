"""Every core query against its SQL on the smallest tables, and the package without its optional part."""

import glob
import os
import subprocess
import sys
from collections import Counter

import pytest

from leadloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    out = duck.execute(catalog.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in out.fetchall())
    assert got == want


def test_nothing_needs_the_optional_part():
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n  def find_spec(self, n, p, t=None):\n    if n.startswith('leadloom.llm'): raise ImportError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(k.startswith('p1_') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_sitemaps_are_composed_whole(spark, tmp_path, monkeypatch):
    from leadloom.plans import q_sources

    rows = [(i, "s.example", f"https://s.example/{i}") for i in range(60)]
    spark.createDataFrame(rows, "page_no bigint, site_domain string, url string").write.parquet(f"{tmp_path}/crawl_page.parquet")
    assert [r["loc"] for r in q_sources.sitemap_locations(spark, str(tmp_path)).orderBy("place").collect()] == [u for _, _, u in rows[:20]]
    monkeypatch.setattr(q_sources.pages, "sitemap_locations", lambda bodies: bodies)
    assert q_sources.sitemap_locations(spark, str(tmp_path)).first()["body"].count("<loc>") == 60
