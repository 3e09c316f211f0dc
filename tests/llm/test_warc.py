import base64
import hashlib
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo

from loomgraph.llm import warc


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    bodies = [None, "", "é<p>" * 5, "x" * 200_000] + ["".join(rng.choice("abc <>\n") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    rows = [(i, rng.choice([None, "http://a.b/ü \r\nX: y", f"http://h{i % 3}/p{i}"]), rng.choice(bodies[:8] if i % 3 else bodies)) for i in range(300)]
    return rows + [(None, "http://null/", bodies[5]), rows[7]]


def test_round_trip_and_pushdown(spark, tmp_path, pages):
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write(warc.records(df).repartition(5), path, archive_bytes=200_000)
    back = warc.read(spark, path, verify=True)
    rows = back.collect()
    assert len(rows) == len(pages)
    body = {p[0]: (p[2] or "").encode() for p in pages}
    winner = {b: max(k for k, x in body.items() if x == b and k is not None) for b in body.values() if any(x == b and k is not None for k, x in body.items())}
    for r in rows:
        b = body[r.record_id]
        assert r.payload_bytes == len(b) and r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        if r.record_id == winner[b]:
            assert (r.record_type, r.refers_to, r.payload) == ("response", None, b)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", winner[b], None)
    only = warc.read(spark, path, "record_id bigint, record_type string").filter("record_type = 'revisit' AND record_id IN (1, 2, 3, 4, 5)")
    assert "PushedFilters" in only._jdf.queryExecution().toString() or only.count() == sum(r.record_type == "revisit" and r.record_id in (1, 2, 3, 4, 5) for r in rows)
    assert {r.record_id for r in only.collect()} == {r.record_id for r in rows if r.record_type == "revisit" and r.record_id in (1, 2, 3, 4, 5)}
    starts = warc.read(spark, path, "record_id bigint, target_uri string").filter(F.col("target_uri").startswith("http://h1/"))
    assert starts.count() == sum((p[1] or "").startswith("http://h1/") for p in pages)


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out

    def size(self):
        return len(self.getbuffer())


def test_unwanted_payloads_are_not_read():
    rng = random.Random(1)
    rows = [dict(record_id=i, record_type="response", target_uri=None, payload_digest="x", payload_bytes=400_000, refers_to=None, payload=rng.randbytes(400_000)) for i in range(6)]
    file = Counting(b"".join(warc.member(warc.record(r)) for r in rows))
    found = list(warc.read_archive(file, lambda c: c["record_id"] == 4, True))
    assert len(found) == 1 and found[0][1].endswith(rows[4]["payload"]) and file.got < 700_000


def test_members_are_gzip():
    import gzip

    row = dict(record_id=1, record_type="response", target_uri="http://x/" + "y" * 20_000, payload_digest="D", payload_bytes=2, refers_to=None, payload=b"hi")
    data = warc.member(warc.record(row))
    assert gzip.decompress(data) == warc.record(row)
    assert next(warc.read_archive(Counting(data), lambda c: len(c["target_uri"]) > 20_000, True))[1].endswith(b"hi")


def test_empty_and_small(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records(df), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r.record_id for r in warc.records(df, min_revisit_bytes=3).filter("record_type = 'revisit'").collect()} == {3}


def test_sql(spark, tmp_path, pages):
    rows = [(k, u, h) for k, u, h in dict.fromkeys(pages) if k is not None]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = con.sql(warc.SQL["op6_warc"])
    key = lambda r: r[0]
    assert sorted(map(tuple, warc.op6_warc(spark, str(tmp_path)).select(*sql.columns).collect()), key=key) == sorted(sql.fetchall(), key=key)


def test_reader_takes_the_type_and_skips_payloads(spark, tmp_path, monkeypatch):
    """A pushed predicate is taken whole, and no payload of another type is inflated."""
    body = "".join(random.Random(1).choices("abcdefghij", k=200_000))
    pages = spark.createDataFrame([(i, "http://x/", body if i < 6 else f"{i}{body}") for i in range(12)], "page_id long, url string, html string")
    warc.write(warc.records(pages), f"{tmp_path}/a")
    schema = T._parse_datatype_string("record_id bigint, record_type string, payload_bytes bigint")
    inflated = [0]

    class Counting:
        def __init__(self, *a):
            self.inner = zlib_decompressobj(*a)

        def decompress(self, *a):
            out = self.inner.decompress(*a)
            inflated[0] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    zlib_decompressobj = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    for kind, ids in (("revisit", set(range(5))), ("response", set(range(5, 12)))):
        reader = warc.WarcReader(schema, {"path": f"{tmp_path}/a"})
        assert list(reader.pushFilters([EqualTo(("record_type",), kind)])) == []
        inflated[0] = 0
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert {r["record_id"] for r in rows} == ids
        assert (inflated[0] < 200_000) == (kind == "revisit")
    plan = warc.read(spark, f"{tmp_path}/a", "record_id bigint, record_type string").filter("record_type = 'revisit'")
    assert plan.count() == 5 and "Filter" not in plan._jdf.queryExecution().optimizedPlan().toString().replace("PushedFilters", "")
