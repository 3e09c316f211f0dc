"""Numbers of lines and of records within files, by as many tasks as a file has splits.

A first pass counts per split; only these counts, one row a split, are summed in order. A second
pass over the same splits adds its own place to that base. No text is shuffled to be numbered. Both
passes must see the same splits: the files must not change between them.

Records of a table with quoted fields may span lines, and splits. Whether a line starts within
quotes depends on all quotes before it, so the first pass counts record starts for both cases, and
the sums tell which holds. Only the lines of records that do span lines are brought together.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most splits whose counts are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 1_000_000


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): lines with the split that they lie in and a number that grows by one a line within it."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _before(value: Column | str) -> Column:
    """The sum of `value` over the splits before, in a table of one row a split."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _small(bases: DataFrame) -> DataFrame:
    return F.broadcast(bases) if bases.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS else bases


def lines_by_split(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value): lines of text files, numbered from 1 in each file."""
    rows = _splits(spark, path)
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    bases = counts.select("path", "block", "first", _before("n").alias("base"))
    return rows.join(_small(bases), ["path", "block"]).select("path", "block", (F.col("base") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines of text files with their number from 1 in each file."""
    return lines_by_split(spark, path).select("path", "line", "value")


def running_count(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """`lines` (path, block, line, ...) with `name`: how many lines of the file up to and with this one have `flag`. Lines of one split meet, never those of a file."""
    marked = lines.withColumn("flag__", F.when(flag, 1).otherwise(0))
    bases = marked.groupBy("path", "block").agg(F.sum("flag__").alias("n__")).select("path", "block", _before("n__").alias("base__"))
    own = F.sum("flag__").over(Window.partitionBy("path", "block").orderBy("line"))
    return marked.withColumn("own__", own).join(_small(bases), ["path", "block"]).withColumn(name, F.col("base__") + F.col("own__")).drop("flag__", "own__", "base__")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    """(split, first, end) of each run of rows of one split; a split is named by the batch's first column."""
    split = batch.column(0)
    n = batch.num_rows
    edge = np.flatnonzero(pc.not_equal(split.slice(1), split.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1 if n > 1 else np.zeros(0, int)
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), n]):
        yield split[a].as_py(), a, b


def _inside(values: pa.Array, parity: int) -> np.ndarray:
    """Whether quotes are open before each line, and after the last, if they are (1) or are not (0) before the first."""
    return (parity + np.r_[0, np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False))]) & 1


def _record_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (split, path, block, value): quotes and, for either state before the split, the records that start in it."""
    now, parity = None, 0
    for batch in batches:
        for split, a, b in _runs(batch):
            if split != now:
                now, parity = split, 0
            values = batch.column(3).slice(a, b - a)
            inside, filled = _inside(values, parity), pc.not_equal(values, "").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, 1), batch.column(2).slice(a, 1), *(pa.array([int(x)], pa.int64()) for x in ((inside[-1] - inside[0]) & 1, (filled & (inside[:-1] == 0)).sum(), (filled & (inside[:-1] == 1)).sum()))],
                names=["path", "block", "odd", "closed", "opened"],
            )
            parity = int(inside[-1])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (split, path, block, value, at, parity, base): the record of each line, and whether it is all of that record."""
    now, parity, count = None, 0, 0
    for batch in batches:
        for split, a, b in _runs(batch):
            if split != now:
                now, parity, count = split, batch.column(5)[a].as_py(), batch.column(6)[a].as_py()
            values = batch.column(3).slice(a, b - a)
            inside, filled = _inside(values, parity), pc.not_equal(values, "").to_numpy(zero_copy_only=False)
            starts = filled & (inside[:-1] == 0)
            record = count + np.cumsum(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), batch.column(4).slice(a, b - a), pa.array(record, pa.int64()), pa.array(starts & (inside[1:] == 0)), pa.array(starts | (inside[:-1] == 1)), values],
                names=["path", "block", "at", "record", "whole", "used", "value"],
            )
            parity, count = int(inside[-1]), int(record[-1])


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, value): the records of comma or tab separated files, numbered from 1 (the header) in each file; blank lines between records have no number."""
    rows = _splits(spark, path).select(F.concat_ws(":", "path", "block").alias("split"), "path", "block", "value", "at")
    counts = rows.select("split", "path", "block", "value").mapInArrow(_record_counts, "path string, block bigint, odd bigint, closed bigint, opened bigint")
    counts = counts.groupBy("path", "block").agg(*(F.sum(c).alias(c) for c in ("odd", "closed", "opened")))
    before = counts.withColumn("parity", (_before("odd") % 2).cast("long"))
    own = F.when(F.col("parity") == 0, F.col("closed")).otherwise(F.col("opened"))
    bases = before.withColumn("own", own).select("path", "block", "parity", _before("own").alias("base"))
    joined = rows.join(_small(bases), ["path", "block"]).select("split", "path", "block", "value", "at", "parity", "base")
    found = joined.mapInArrow(_placed, "path string, block bigint, at bigint, record bigint, whole boolean, used boolean, value string").filter("used")
    parts = found.filter("NOT whole").groupBy("path", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda s: s["value"]), "\n").alias("value"))
    return found.filter("whole").select("path", "record", "value").unionByName(parts)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of quoted tables with a header, all as strings, with path__ and record__ (2 for the first row after the header); the header is that of the first file."""
    records = numbered_records(spark, path)
    head = records.filter("record = 1").agg(F.min_by("value", "path")).first()[0]
    if head is None:
        raise ValueError("a table needs a header row")
    names = next(csv.reader([head.lstrip("﻿")], delimiter=sep), []) if "\n" not in head else next(csv.reader(head.split("\n"), delimiter=sep))
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    row = F.from_csv("value", fields, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    return records.filter("record > 1").select(F.col("path").alias("path__"), F.col("record").alias("record__"), row.alias("r__")).select("path__", "record__", "r__.*")
