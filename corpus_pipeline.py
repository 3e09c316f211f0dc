"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet and read again. All but the last return the columns of `documents`.

A document is known by its id and a hash of its text, so rows that repeat an id with another
text are judged alone. Verdicts are small tables without texts, each with one struct column of a
name that the documents do not have; a stage applies them by a join that is broadcast only after
a count. Columns beyond `documents` pass through all stages but the last, whatever their names.
A null text is judged as an empty one and stays null. Whole texts are read, however long; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bpe, decontaminate, jaccard, quality, secrets
from loomgraph.llm.common import broadcast_if_small, cut, free_name

BROADCAST_ROWS = 1_000_000
#: Stage 4 and 5 have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(F.col("doc_id").alias("doc_id"), _hash().alias("h")).alias("key"), "text")


def _same(docs: DataFrame, name: str) -> F.Column:
    """Whether a row of `docs` is the document that the struct column `name` (doc_id, h) of another table names."""
    return F.col("doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (_hash() == F.col(f"{name}.h"))


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`docs` but those named by `verdicts` (doc_id, h)."""
    name = free_name(docs, "gone")
    gone = cut(verdicts.select(F.struct("doc_id", "h").alias(name)).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, BROADCAST_ROWS), _same(docs, name), "left_anti")


def _column(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _first_of_repeated(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """`docs` with one row for each document named by `repeated` (doc_id, h): the least by all columns in turn, maps as JSON."""
    name = free_name(docs, "again")
    again = cut(repeated.select(F.struct("doc_id", "h").alias(name)).distinct(), "again")
    again = broadcast_if_small(again, BROADCAST_ROWS)
    alone = docs.join(again, _same(docs, name), "left_anti")
    order = [F.to_json(F.struct(_column(f.name))) if isinstance(f.dataType, T.MapType) else _column(f.name) for f in docs.schema.fields]
    whole = F.struct(*(_column(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    some = docs.join(again, _same(docs, name), "left_semi").groupBy(F.col("doc_id").alias("a"), _hash().alias("b")).agg(F.min_by(whole, F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("w"))
    return alone.union(some.select(*(F.col(f"w.c{k}").alias(c) for k, c in enumerate(docs.columns))))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail for want of words and go; equal rows share a verdict, so all of
    them stay or all go.
    """
    found = quality.quality_rules(_keyed(docs), id_col="key")
    return _without(docs, found.filter("NOT kept").select("key.doc_id", "key.h"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more connect: that of the least id, a null id before all, and of one id's texts that of the least hash.

    Texts without words link with none and stay. Of rows that repeat both id and text one stays,
    the least by its columns in turn.
    """
    found = cut(jaccard.jaccard_join(_keyed(docs), id_col="key"), "links")
    kept = _without(docs, found.filter(~F.col("key").eqNullSafe(F.col("class_id"))).select("key.doc_id", "key.h"))
    again = found.filter(F.col("key").eqNullSafe(F.col("class_id"))).groupBy("key").count().filter("count > 1")
    return kept if again.isEmpty() else _first_of_repeated(kept, again.select("key.doc_id", "key.h"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts have no words and stay; equal rows share a verdict; without benchmark
    items all stay.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated").select("doc_id", "h"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in angle brackets, n_chars counted anew where a text changes.

    Null texts stay null; equal rows are changed alike; of overlapping secrets the first names the
    kind.
    """
    name = free_name(docs, "hit")
    found = secrets.scan(_keyed(docs), id_col="key").filter(F.size("spans") > 0).dropDuplicates(["key"])
    hits = cut(found.select(F.struct("key.doc_id", "key.h", "spans").alias(name)), "spans")
    hits = broadcast_if_small(hits, BROADCAST_ROWS, F.size(f"{name}.spans") + 1)
    spans = F.col(f"{name}.spans")
    # the new text gets a name of its own first: beside an alias `text`, a lambda would read that for the column
    new = free_name(docs, "redacted")
    joined = docs.join(hits, _same(docs, name), "left").withColumn(new, F.when(spans.isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), spans)))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return joined.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else _column(c) for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (the tokens of each document) and a digest of what they decode to; null and empty texts have none. One row for each row."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
