"""Every registered query runs on the smallest tables, and equals its SQL where it has any."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from loomstone.plans import parts, registry, stored, upkeep  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 4)
    return v if isinstance(v, bool | int | str) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in registry.SQL:
        return
    want = duck.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    a = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_the_rest_works_without_the_text_corpus_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("loomstone.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert "document_search" in e.queries() and not [k for k in e.queries() if k.startswith("op")], e.queries().keys()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_plans_push_down_and_broadcast(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(registry.QUERIES["canonical_urls"](spark, sf))
    assert "html" not in text.split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan(registry.QUERIES["top_per_key"](spark, sf))
    assert "Python" not in plan(registry.QUERIES["bm25_matches"](spark, sf))
