import os

import pytest

import __spark_entry__ as e
from corpuslens.plans import catalog

DATA = "/root/testdata/sf0.001"
HAS = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def value(v):
    if isinstance(v, list):
        return [value(x) for x in v]
    return round(v, 6) if isinstance(v, float) else v


def against_sql(spark, name, query, sql, root):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(root):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{root}/{f}'")
    done = c.execute(sql)
    names = [d[0] for d in done.description]
    df = query(spark, root)
    assert sorted(names) == sorted(df.columns), name
    want = [[value(r[names.index(k)]) for k in df.columns] for r in done.fetchall()]
    got = [[value(x) for x in r] for r in df.collect()]
    assert same(got, want), name


@HAS
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_core_query_equals_sql(spark, name):
    against_sql(spark, name, catalog.QUERIES[name], catalog.SQL[name], DATA)


def test_only_the_subpackage_may_be_missing(monkeypatch):
    import importlib
    import sys

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpuslens.llm", None)
        assert set(importlib.reload(e).queries()) == set(catalog.QUERIES)
    try:
        from corpuslens.llm import queries  # noqa: F401
    except ImportError:
        return
    with monkeypatch.context() as m:
        m.delattr(sys.modules["corpuslens.llm"], "queries")
        m.setitem(sys.modules, "corpuslens.llm.queries", None)
        with pytest.raises(ImportError, match="queries"):
            importlib.reload(e)
    importlib.reload(e)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corpuslens.sources.tables import shared_folder

    on = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(on("spark://a", "hdfs://x")) == "hdfs://x" and os.path.isdir(shared_folder(on("local[2]", None)))
    for master in ("spark://a", "local-cluster[2,1,900]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(on(master, None))


@HAS
def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
