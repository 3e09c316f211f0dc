"""Size-tiered compaction of an append-only store of Parquet shards.

Arrivals are appended as small immutable shards, one a task. Compaction puts shards into tiers
by size and merges runs of one tier into files of about the target size. Every change commits a
manifest: a new file with the next version, put in place by a rename that fails if the version
exists, so a reader sees the old state or the new one and of two writers one fails.

Shards are read and written by DataFrames only; a merge reads the files of its run in one task
and shuffles nothing. The driver holds the manifest: some hundred bytes a shard.

Defined results: all rows and columns are kept as they are, with nulls, repeated rows and any
column names; arrivals without rows add a version but no shard; an empty store reads as an
empty table of the schema it was opened with. A single row is never split, so a shard may
exceed the target by what one task wrote.
"""

from __future__ import annotations

import json
import time
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_at_exit, scratch_path


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def tier(size: int, base: int = 1 << 20, factor: int = 4) -> int:
    """0 up to `base` bytes; one more for each `factor`."""
    return 0 if size <= base else 1 + int(math.log(size / base, factor))


def plan_merges(shards: list[dict], target: int, min_runs: int = 4, factor: int = 4) -> list[list[dict]]:
    """Runs to merge: shards of one tier, none of half the target or more, cut where a run would pass the target. A run has two shards at least; a tier's last run, if it stays below half the target, `min_runs`."""
    tiers: dict[int, list[dict]] = {}
    for s in sorted(shards, key=lambda s: (s["added"], s["path"])):
        if 2 * s["bytes"] < target:
            tiers.setdefault(tier(s["bytes"], max(1, target // factor**4), factor), []).append(s)
    merges = []
    for _, found in sorted(tiers.items()):
        run: list[dict] = []
        for s in found:
            if run and sum(x["bytes"] for x in run) + s["bytes"] > target:
                merges.append(run)
                run = []
            run.append(s)
        if len(run) >= min_runs or len(run) > 1 and 2 * sum(x["bytes"] for x in run) >= target:
            merges.append(run)
    return [m for m in merges if len(m) > 1]


@contextmanager
def _unions_apart(spark: SparkSession) -> Iterator[None]:
    """A union keeps the partitions of its parts. Spark 4.1 would make one partition of parts that have one each, so all runs would be one task and one file."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class ShardStore:
    """A store of shards below `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._jvm, self._hadoop = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._hadoop)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # manifests

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "shards": [{"path", "rows", "bytes", "added"}]}: the latest, or a given one."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version == 0:
            return {"version": 0, "shards": []}
        if version not in found:
            raise ValueError(f"no version {version}")
        rows = self.spark.read.text(str(self._path(f"manifest/v{version:010d}.json").toString())).collect()
        return json.loads("".join(r.value for r in rows))

    def commit(self, base: int, shards: list[dict]) -> int:
        """Make `shards` version base + 1, or raise Conflict.

        The version appears whole or not at all where the file system renames atomically without
        overwriting (HDFS does). On a plain local file system two writers that commit at one
        instant may both pass the check for an older version; on object stores use one writer.
        """
        version = base + 1
        hidden, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{version:010d}.json")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps({"version": version, "shards": shards}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._hadoop)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(hidden, final, none)
        except Exception as e:
            self._fs.delete(hidden, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    # shards

    def _written(self, folder: str, version: int) -> list[dict]:
        """The shards with rows in a folder that a job has written."""
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")}
        if not files:
            return []
        name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
        counts = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").groupBy(name.alias("name")).count().collect()
        return [{"path": f"{folder}/{r['name']}", "rows": r["count"], "bytes": files[r["name"]], "added": version} for r in sorted(counts, key=lambda r: r["name"])]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def append(self, df: DataFrame, compression: str = "zstd", tries: int = 5) -> int:
        """Add the rows of `df` as one shard a task and commit. A lost race is tried again on the new version; the shards are not written again."""
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError("the columns of an arrival must be those of the store")
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(f"{self.path}/{folder}")
        new = self._written(folder, 0)
        for k in range(tries):
            now = self.manifest()
            try:
                return self.commit(now["version"], now["shards"] + [s | {"added": now["version"] + 1} for s in new])
            except Conflict:
                if k == tries - 1:
                    raise
        raise ValueError("tries must be at least 1")

    def compact(self, target: int = 256 << 20, min_runs: int = 4, max_merges: int = 64, compression: str = "zstd") -> int:
        """Merge runs until none is due; each round is one job of at most `max_merges` runs and one commit. Returns the version."""
        while True:
            now = self.manifest()
            merges = plan_merges(now["shards"], target, min_runs)[:max_merges]
            if not merges:
                return now["version"]
            folder = f"shards/{uuid.uuid4().hex}"
            runs = [self._read([s["path"] for s in run]).coalesce(1) for run in merges]
            with _unions_apart(self.spark):
                reduce(DataFrame.union, runs).write.option("compression", compression).parquet(f"{self.path}/{folder}")
            gone = {s["path"] for run in merges for s in run}
            new = self._written(folder, now["version"] + 1)
            if sum(s["rows"] for s in new) != sum(s["rows"] for run in merges for s in run):
                raise RuntimeError("a merge lost rows")
            self.commit(now["version"], [s for s in now["shards"] if s["path"] not in gone] + new)

    def vacuum(self, keep_versions: int = 1, grace_seconds: float = 86_400.0) -> int:
        """Delete the shards that none of the last versions names, and older manifests. Returns how many shards went.

        Shards that no version names, of an append or merge that was lost, go once they are older
        than `grace_seconds`: younger ones may belong to a writer at work.
        """
        found = self.versions()
        keep = set(found[-keep_versions:])
        named = {s["path"] for v in keep for s in self.manifest(v)["shards"]}
        gone = {s["path"] for v in found if v not in keep for s in self.manifest(v)["shards"]} - named
        last = (time.time() - grace_seconds) * 1000
        top = self._path("shards")
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = folder.getPath().getName()
            files = {f"shards/{name}/{s.getPath().getName()}": s.getModificationTime() for s in self._fs.listStatus(folder.getPath())}
            shards = {p for p in files if p.rsplit("/", 1)[1].startswith("part-")}
            gone |= {p for p in shards - named if files[p] < last}
            if not shards - gone and folder.getModificationTime() < last:
                gone |= shards
                self._fs.delete(folder.getPath(), True)
        for p in gone:
            self._fs.delete(self._path(p), False)
        for v in found:
            if v not in keep:
                self._fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        shards = self.manifest(version)["shards"]
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self._read([s["path"] for s in shards])


#: Shares in sixteenths of the arrivals that the query appends.
ARRIVALS = (8, 4, 2, 1, 1)


def _stored(spark, sf_dir: str, target: int) -> DataFrame:
    """The documents, appended as arrivals of several sizes, compacted and read back from the last version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch_path(spark, "shards"), docs.schema)
    share = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16, F.lit(0))
    low = 0
    for width in ARRIVALS:
        store.append(docs.filter((share >= low) & (share < low + width)))
        low += width
    version = store.compact(target)
    drop_at_exit(spark, store.path)
    return store.read(version)


def op7_sharding(spark, sf_dir: str, target: int = 64 << 20) -> DataFrame:
    """Append the documents as arrivals of several sizes, compact, and return each document's shard as read back."""
    return _stored(spark, sf_dir, target).select(
        "doc_id",
        F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)$", 1).alias("shard"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def sharding_contents(spark, sf_dir: str, target: int = 64 << 20) -> DataFrame:
    """What the store holds, without the names of its shards, which are drawn at random and no SQL can state."""
    return _stored(spark, sf_dir, target).select("doc_id", "lang", "source", "n_chars", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: Read back, a version holds each row once.
SQL = {"sharding_contents": "SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents"}
