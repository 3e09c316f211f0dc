import os

import duckdb
import pytest

from loomgraph import scratch
from loomgraph.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    frame = queries.QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(want.columns)
    got = sorted(map(tuple, frame.select(*want.columns).collect()), key=repr)
    scratch.drop_all(spark)
    assert got == sorted(want.fetchall(), key=repr) and got
