"""Stored, mergeable pair counts: a versioned table that takes batches of documents by upsert.

A batch becomes one immutable folder of summed counts. A version is a small manifest that names the
folders of its batches; it is committed by creating a file that must not exist yet, so of two
writers of one version one fails and nothing is half done. A batch that a version knows is not
counted again, however often it comes, also when a job repeats it after a failure. Counts are
integers (of 1/k in parts of the least common multiple), so sums do not depend on the order of
batches. `compact` sums the folders into one; `vacuum` removes folders that no kept version names.

Words below a document's frequency limit cannot be told apart batch by batch, so `min_count` is
applied when edges are asked for, to pairs as they were counted, over all words.
"""

from __future__ import annotations

import json
import time
import uuid
from math import lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators.pairs import distance_parts, pair_sums


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class PairStore:
    """Pair and word counts of all batches added so far, in the folder `path`, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str, window: int = 4):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window
        self.whole = lcm(*range(1, window + 1))
        held = self._manifest()
        if held.get("window", window) != window:
            raise ValueError(f"the store counts a window of {held['window']}")

    # files

    def _files(self, path: str) -> tuple:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _names(self, path: str) -> list[tuple[str, int]]:
        files, folder = self._files(path)
        return [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(folder)] if files.exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self._names(f"{self.path}/versions") if n.endswith(".json") and n[:1].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "batches": {}, "folders": [], "window": self.window}
        files, file = self._files(f"{self.path}/versions/{known[-1] if version is None else version:08d}.json")
        stream = files.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Writes the manifest aside and renames it to its version, which must not exist: HDFS refuses that, a local file system is asked first; an object store needs a conditional put in this place."""
        files, aside = self._files(f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = files.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, file = self._files(f"{self.path}/versions/{manifest['version']:08d}.json")
        if files.exists(file) or not files.rename(aside, file):
            files.delete(aside, False)
            raise Conflict(f"version {manifest['version']} exists")

    # batches

    def _write(self, pairs: DataFrame, words: DataFrame) -> str:
        name = uuid.uuid4().hex
        pairs.write.parquet(f"{self.path}/data/{name}/pairs")
        words.write.parquet(f"{self.path}/data/{name}/words")
        return name

    def add(self, arrays: DataFrame, batch: str, tries: int = 5) -> bool:
        """Counts the documents (doc_id, tokens) under the name `batch`; False if a batch of that name is counted already. A lost race is tried again: what was counted is not."""
        if batch in self._manifest()["batches"]:
            return False
        pairs = pair_sums(arrays, self.window, distance_parts(self.window)[1], loops=False)
        words = arrays.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
        name = self._write(pairs.select("a", "b", F.col("n").alias("parts")), words)
        for k in range(tries):
            held = self._manifest()
            if batch in held["batches"]:
                return False  # the folder is left for `vacuum`
            try:
                self._commit({"version": held["version"] + 1, "batches": held["batches"] | {batch: name}, "folders": [*held["folders"], name], "window": self.window})
                return True
            except Conflict:
                if k == tries - 1:
                    raise
        return False

    def compact(self) -> None:
        """Sums all folders into one, as a new version; batches stay known."""
        held = self._manifest()
        if len(held["folders"]) < 2:
            return
        name = self._write(self._sum("pairs", ["a", "b"], "parts", held), self._sum("words", ["token"], "freq", held))
        self._commit(held | {"version": held["version"] + 1, "folders": [name]})

    def vacuum(self, keep: int = 2, grace_seconds: float = 86_400.0) -> int:
        """Removes manifests but the last `keep`, and folders that these do not name and that are older than the grace, which a writer at work has; gives their number."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self._manifest(v)["folders"]}
        for v in known[:-keep]:
            files, file = self._files(f"{self.path}/versions/{v:08d}.json")
            files.delete(file, False)
        gone = [n for n, at in self._names(f"{self.path}/data") if n not in named and at < (time.time() - grace_seconds) * 1000]
        for n in gone:
            files, folder = self._files(f"{self.path}/data/{n}")
            files.delete(folder, True)
        return len(gone)

    # results

    def _sum(self, kind: str, keys: list[str], value: str, held: dict) -> DataFrame:
        schema = "a string, b string, parts bigint" if kind == "pairs" else "token string, freq bigint"
        paths = [f"{self.path}/data/{n}/{kind}" for n in held["folders"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*keys).agg(F.sum(value).alias(value))

    def words(self, version: int | None = None) -> DataFrame:
        """(token, freq)."""
        return self._sum("words", ["token"], "freq", self._manifest(version))

    def total_tokens(self, version: int | None = None) -> int:
        return self.words(version).agg(F.sum("freq")).first()[0] or 0

    def edges(self, min_count: int = 1, version: int | None = None) -> DataFrame:
        """(src, dst, weight), src < dst: 1/k summed over pairs k places apart, of words of at least `min_count`."""
        out = self._sum("pairs", ["a", "b"], "parts", self._manifest(version)).select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("parts") / self.whole).alias("weight"))
        if min_count > 1:
            kept = self.words(version).filter(F.col("freq") >= min_count)
            out = out.join(kept.select(F.col("token").alias("src")), "src", "left_semi").join(kept.select(F.col("token").alias("dst")), "dst", "left_semi")
        return out

    def association(self, kind: str = "ppmi", version: int | None = None) -> DataFrame:
        """`graphs.association` of the counts as they stand: every sum is taken anew."""
        return graphs.association(self.edges(1, version), self.words(version), kind)


def add_stream(store: PairStore, stream: DataFrame, checkpoint: str):
    """Feeds a stream of (doc_id, tokens) into the store, a batch at a time, named by its number: a batch that is repeated after a failure is counted once. Returns the started query."""
    return stream.writeStream.foreachBatch(lambda rows, n: store.add(rows, f"stream-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
