"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs up to this size are dealt out anew; beyond it files and row groups give enough tasks, and no shuffle is added.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """`df`, over all cores if it is small by the planner's own size estimate: a small file is one row group, which one task would read and work through alone."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= small_bytes else df
