"""Sinks: corpora with splits and reports, graphs, token shards, registries, review templates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..operators import tokens as TK
from ..scratch import cut


def write_corpus(records: DataFrame, verdicts: DataFrame, path: str, val: float = 0.1, test: float = 0.05, seed: int = 0) -> DataFrame:
    """Write accepted texts by split, rejected rows, a quality report and a manifest below `path`; returns the manifest (split, n, digest).

    `records`: (doc_id, text); `verdicts`: of `build_corpus`.
    """
    joined = records.select("doc_id", "text").join(verdicts, "doc_id")
    kept = corpus.split(joined.filter("reason IS NULL"), val, test, seed)
    kept.select("text", "split", "text_hash").write.partitionBy("split").parquet(f"{path}/records")
    joined.filter("reason IS NOT NULL").write.json(f"{path}/rejected")
    corpus.quality_report(verdicts).coalesce(1).write.json(f"{path}/quality_report")
    back = records.sparkSession.read.parquet(f"{path}/records")
    back.select(F.regexp_replace("text", r"\s*\n\s*", " ").alias("text"), "split").write.partitionBy("split").text(f"{path}/text")
    manifest = corpus.split_hashes(back)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return records.sparkSession.read.json(f"{path}/manifest")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, config: dict | None = None) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    nodes.sparkSession.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/config")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), config


def graph_summary(nodes: DataFrame, edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: nodes, edges, relations, and the share of distinct `tokens` (token) that are nodes."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.array_sort(F.collect_set("relation")).alias("relations"))
    words = tokens.select("token").distinct()
    share = words.join(nodes.select(F.col("label").alias("token"), F.lit(1).alias("known")), "token", "left").agg(F.coalesce(F.avg(F.when(F.col("known").isNull(), 0.0).otherwise(1.0)), F.lit(0.0)).alias("token_coverage"))
    return n.crossJoin(e).crossJoin(share)


def cached_graph(spark: SparkSession, folder: str, key: dict, build) -> tuple[DataFrame, DataFrame, dict]:
    """The graph stored under the hash of `key`, built and stored by `build() -> (nodes, edges)` if it is not there."""
    path = f"{folder}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/config/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        nodes, edges = build()
        write_graph(nodes, edges, path, key)
    return read_graph(spark, path)


def write_token_shards(encoded: DataFrame, path: str, tokens_per_shard: int = 2_000_000) -> DataFrame:
    """Write (doc_id, ids) as shards of a fixed number of tokens in document order; returns (shard, n, digest)."""
    placed = TK.offsets(encoded, F.size("ids")).select("start", F.posexplode("ids").alias("pos", "id")).select((F.col("start") + F.col("pos")).alias("at"), "id")
    sharded = placed.withColumn("shard", F.floor(F.col("at") / tokens_per_shard))
    sharded.repartitionByRange("at").sortWithinPartitions("at").write.partitionBy("shard").parquet(path)
    back = encoded.sparkSession.read.parquet(path)
    part = back.groupBy("shard", F.floor(F.col("at") / 10_000).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"].cast("string")), ","), 256).alias("h"))
    return part.groupBy("shard").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "h"))), lambda s: s["h"]), ","), 256).alias("digest"))


def write_binary_shards(encoded: DataFrame, path: str, split: str = "train", tokens_per_shard: int = 2_000_000) -> DataFrame:
    """Write (doc_id, ids) as files `split`-00000.tokens.bin of `tokens_per_shard` little-endian int64 each, in document order; returns the manifest (split, path, dtype, num_tokens, sha256).

    A shard is one group of bounded size; `path` must be a folder that all workers share.
    """
    size = max(1, tokens_per_shard)
    placed = TK.offsets(encoded, F.size("ids")).select("start", F.posexplode("ids").alias("pos", "id")).select((F.col("start") + F.col("pos")).alias("at"), F.col("id").cast("long").alias("id"))

    def write(group):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        at, ids = group.column("at").to_numpy(), group.column("id").to_numpy()
        shard = int(at[0] // size)
        data = ids[np.argsort(at)].astype("<i8").tobytes()
        name = f"{split}-{shard:05d}.tokens.bin"
        files, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{name}") as out:
            out.write(data)
        return pa.table({"split": [split], "path": [name], "dtype": ["int64"], "num_tokens": pa.array([len(ids)], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    shards = placed.withColumn("shard", F.floor(F.col("at") / size)).groupBy("shard").applyInArrow(write, "split string, path string, dtype string, num_tokens bigint, sha256 string")
    return cut(shards, "shards")  # written once, not again by each reader of the manifest


def write_articles(prepared: DataFrame, path: str, val: float = 0.1, seed: int = 0) -> DataFrame:
    """Write `corpus.prepare_articles` rows with their `id` as folders corpus, train, validation (lines), prepared_articles and rejected_records (JSON), manifest; returns the manifest (name, value)."""
    rows = cut(prepared)
    good = rows.filter("reason IS NULL").withColumn("key", F.concat_ws(":", F.col("id").cast("string"), F.sha2("line", 256)))
    placed = cut(corpus.split(good, seed=seed, key="key", counts=corpus.article_split_counts(good.count(), val)).drop("key"))
    text = lambda df: df.orderBy("id").select(F.col("line").alias("value"))
    text(placed).write.mode("overwrite").text(f"{path}/corpus")
    for name in ("train", "validation"):
        text(placed.filter(F.col("split") == name)).write.mode("overwrite").text(f"{path}/{name}")
    placed.drop("split", "reason").withColumnRenamed("line", "corpus_text").write.mode("overwrite").json(f"{path}/prepared_articles")
    rows.filter("reason IS NOT NULL").drop("line").write.mode("overwrite").json(f"{path}/rejected_records")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("double")
    stats = placed.agg(
        F.count(F.lit(1)).cast("double").alias("accepted_records"), count(F.col("split") == "train").alias("train"), count(F.col("split") == "validation").alias("validation"),
        *(f(F.length(c)).cast("double").alias(f"{n}_{k}") for c, n in (("body", "body_chars"), ("line", "corpus_chars")) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))),
    ).crossJoin(rows.filter("reason IS NOT NULL").agg(F.count(F.lit(1)).cast("double").alias("rejected_records")))
    manifest = cut(stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in stats.columns))).alias("x")).select("x.*"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def hash_json(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def write_registry(spark: SparkSession, path: str, run_id: str, config: dict, metrics: dict) -> None:
    """One JSON row about a run, appended to the registry."""
    row = json.dumps({"run_id": run_id, "config": config, "config_sha256": hash_json(config), "metrics": metrics}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)


def run_report(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, config_sha256, metric, value) of all runs of a registry."""
    rows = spark.read.text(path)
    get = lambda n: F.get_json_object("value", f"$.{n}")
    return rows.select(get("run_id").alias("run_id"), get("config_sha256").alias("config_sha256"), F.explode(F.from_json(get("metrics"), "map<string,double>")).alias("metric", "value"))


def write_review(prompts: DataFrame, path: str) -> None:
    """A template for human review: (id, prompt, output) with empty score columns, as JSON lines and as CSV."""
    template = prompts.select("id", "prompt", "output", *(F.lit(None).cast("int").alias(c) for c in ("fluency", "relevance", "factuality")), F.lit("").alias("notes"))
    template.write.json(f"{path}/json")
    template.write.option("header", True).csv(f"{path}/csv")
