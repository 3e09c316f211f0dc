"""WARC archives as a Python data source.

Writing: each task writes immutable archives of gzip members, one a record, and the commit
writes a manifest naming the archives of the tasks that succeeded, so lost or repeated tasks
leave nothing behind that a reader sees. Each member's gzip header has the `sl` extra field
with its compressed and full length.

Reading: one partition for each archive in the manifests. Predicates on the record type and
other header columns are pushed down; a record's headers are inflated first, and the rest of a
member that is not wanted is skipped by its `sl` length, neither read nor inflated. Payloads
are inflated only if the schema asks for them or the digest is to be verified. An empty table
makes no archive, and none are read; a payload must fit a task, however long it is.

Defined results: a null payload is empty; a null id, URL or reference has no header and is read
as null; control characters in URLs are percent-encoded; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import drop_at_exit, scratch_path

RECORD_SCHEMA = "record_id bigint, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
ID_PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date, so that equal input makes equal archives.
DATE = "2020-01-01T00:00:00Z"
GZIP_HEADER = struct.Struct("<4sIBBH2sHII")
HEAD_READ = 16 << 10


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(row: dict) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP headers of the response and no payload."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    body = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {DATE}"]
    if row["record_id"] is not None:
        lines.append(f"WARC-Record-ID: <{ID_PREFIX}{row['record_id']}>")
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_safe(row['target_uri'])}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells how long it is."""
    pressed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pressed.compress(data) + pressed.flush()
    total = GZIP_HEADER.size + len(body) + 8
    return GZIP_HEADER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _number(value: str | None) -> int | None:
    return int(value.strip("<>")[len(ID_PREFIX) :]) if value else None


def head_columns(headers: dict[str, str]) -> dict:
    """The columns that a record's own headers hold."""
    return {
        "record_id": _number(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": _number(headers.get("warc-refers-to")),
    }


def _inflate_head(engine, data: bytes) -> bytes:
    """Inflated bytes up to the end of the record's headers at least."""
    out, rest = b"", data
    while b"\r\n\r\n" not in out and (rest or not out):
        out += engine.decompress(rest, 2048)
        rest = engine.unconsumed_tail
        if not rest:
            break
    return out


def read_archive(file, wanted, need_body: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(header columns, body) of the records that `wanted(columns)` accepts; body is None unless needed."""
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        data = file.read(min(HEAD_READ, size - at))
        magic, _, _, _, xlen, name, _, total, _ = GZIP_HEADER.unpack_from(data)
        if magic != b"\x1f\x8b\x08\x04" or name != b"sl" or xlen != 12:
            raise ValueError(f"at byte {at}: no gzip member with an sl field")
        engine = zlib.decompressobj(-15)
        data = data[:total]
        head = _inflate_head(engine, data[GZIP_HEADER.size :])
        while b"\r\n\r\n" not in head and len(data) < total:  # headers longer than one read
            data += (more := file.read(min(HEAD_READ, total - len(data))))
            head += engine.decompress(more)
        block, _, start = head.partition(b"\r\n\r\n")
        headers = _headers(block)
        columns = head_columns(headers)
        if wanted(columns):
            body = None
            if need_body:
                rest = engine.unconsumed_tail + (file.read(total - len(data)) if len(data) < total else b"")
                body = (start + engine.decompress(rest))[: int(headers["content-length"])]
            yield columns, body
        at += total


def matches(filters: list[tuple], columns: dict) -> bool:
    """Whether the header columns satisfy all pushed filters, each (kind, column, value)."""
    for kind, name, value in filters:
        found = columns[name]
        if kind == "notnull" and found is None or kind == "eq" and (found is None or found != value) or kind == "same" and found != value or kind == "in" and found not in value:
            return False
        if kind == "starts" and (found is None or not found.startswith(value)):
            return False
    return True


class WarcPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    HEAD = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            kind = {EqualTo: "eq", EqualNullSafe: "same", In: "in", IsNotNull: "notnull", StringStartsWith: "starts"}.get(type(f))
            if name in self.HEAD and kind:
                self.filters.append((kind, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        system, folder = open_folder(self.path)
        names = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as f:
                    names += json.loads(f.read())["archives"]
        return [WarcPartition(n) for n in sorted(names)]

    def read(self, partition):
        if partition is None:  # no archive has been committed
            return
        system, folder = open_folder(self.path)
        names, rows = self.schema.names, []
        arrow = pa.schema([(f.name, {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}[f.dataType]) for f in self.schema])
        need = self.verify or bool({"payload", "payload_bytes"} & set(names))
        held = 0
        with system.open_input_file(f"{folder}/{partition.path}") as file:
            for columns, body in read_archive(file, lambda c: matches(self.filters, c), need):
                if need:
                    head, _, payload = body.partition(b"\r\n\r\n")
                    columns["payload_bytes"] = int(_headers(head)["content-length"])
                    full = columns["record_type"] != "revisit"
                    columns["payload"] = payload if full else None
                    if self.verify and full and (len(payload) != columns["payload_bytes"] or digest(payload) != columns["payload_digest"]):
                        raise ValueError(f"record {columns['record_id']}: its payload does not have its digest")
                    held += len(payload) if "payload" in names else 0
                rows.append({n: columns[n] for n in names})
                if len(rows) >= 5000 or held >= 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class Archives(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.target = int(options.get("archive_bytes", 64 << 20))

    def write(self, iterator):
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                if out is None:
                    names.append(f"archive-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record({n: c[i].as_py() for n, c in zip(batch.schema.names, columns)}))
                out.write(data)
                size += len(data)
                if size >= self.target:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Archives(names)

    def commit(self, messages):
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        name = f"manifest-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{folder}/.{name}", compression=None) as f:
            f.write(json.dumps({"archives": [n for m in messages if m is not None for n in m.names]}).encode())
        system.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages):
        system, folder = open_folder(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                system.delete_file(f"{folder}/{n}")


class WarcSource(DataSource):
    """`spark.read.format("warc")`, after `register(spark)`. Options: path, verify, archive_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are immutable; use mode('append')")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """The records to write for a table of pages.

    Of records with equal payloads of at least `min_revisit_bytes`, that with the largest id is
    the response and the others revisit it, without their payload. Rows that repeat the largest
    id are responses too; null ids come before all others.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    pages = pages.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    # only payloads that several pages share travel in this table
    shared = pages.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.max("record_id").alias("winner"))
    out = pages.join(shared.filter("copies > 1").drop("copies"), "sha", "left")
    revisit = F.col("winner").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("winner"))
    return out.select(
        "record_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        base32(F.col("sha")).alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, F.col("winner")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(sha: F.Column) -> F.Column:
    """Upper-case base32 of a 20-byte value."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = F.hex(sha)

    def four(i: F.Column) -> F.Column:
        bits = F.conv(F.substring(digits, (i * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(alphabet, (F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def write(df: DataFrame, path: str, archive_bytes: int = 64 << 20) -> None:
    register(df.sparkSession)
    df.write.format("warc").option("archive_bytes", archive_bytes).mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, verify: bool = False) -> DataFrame:
    """The records of all committed archives; name only the columns needed in `schema`."""
    register(spark)
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    drop_at_exit(spark, path)
    columns = "record_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"
    # the type is pushed down: payloads are inflated to be verified, and skipped unread for the revisits
    full = read(spark, path, columns, verify=True).filter("record_type = 'response'")
    back = full.union(read(spark, path, columns).filter("record_type = 'revisit'"))
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS sha FROM pages),
w AS (SELECT sha, max(page_id) AS winner FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p JOIN w USING (sha)
"""
}
