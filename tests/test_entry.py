import os
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph import scratch
from loomgraph.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_imports_without_the_optional_parts():
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith("loomgraph.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.queries()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def as_rows(found):
    """Rows with numbers as equal values compare in both engines."""
    plain = lambda v: float(v) if isinstance(v, Decimal) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    frame = entry.queries()[name](spark, DATA)
    assert sorted(frame.columns) == sorted(want.columns)
    got, want = as_rows(frame.select(*want.columns).collect()), as_rows(want.fetchall())
    scratch.drop_all(spark)
    assert got == want and got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 30
