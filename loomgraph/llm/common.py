"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, drop_at_exit, scratch_path, shared_dir  # noqa: F401

#: ASCII white space, as `bytes.split()` sees it: space and \x09-\x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def broadcast_if_small(df: DataFrame, max_rows: int, entries: Column | None = None) -> DataFrame:
    """Hint a broadcast if a count shows that `df` (a written table) has at most `max_rows` rows, else leave the join to a shuffle. `entries`: what a row counts for, where it holds an array."""
    if entries is None:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
    return F.broadcast(df) if (df.agg(F.sum(entries)).collect()[0][0] or 0) <= max_rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Have Arrow batches hold at most about `size` bytes, not only so many rows: whole texts are long. The session keeps this setting, since frames run after they are made."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return what a task has freed to the system: workers are used again and would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, so that others cannot clash; null text becomes empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo `modulus`."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def map_chunks(
    df: DataFrame,
    work: Callable[[pa.Array, list[bytes]], pa.RecordBatch],
    schema: T.StructType,
    chunk_bytes: int = 2 << 20,
) -> DataFrame:
    """Apply `work(ids, texts)` to chunks of (id, text) rows of about `chunk_bytes`; a longer text is a chunk alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            start, held = 0, 0
            for i, size in enumerate(pc.binary_length(texts).to_pylist()):
                if held and held + size > chunk_bytes:
                    yield work(ids.slice(start, i - start), texts.slice(start, i - start).to_pylist())
                    start, held = i, 0
                held += size
            if start < len(texts):
                yield work(ids.slice(start), texts.slice(start).to_pylist())
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema["id"].dataType, True)
