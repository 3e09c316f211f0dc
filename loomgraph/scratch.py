"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, and an error on a cluster, whose executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a written folder removed when the application ends, or by `drop_all`."""
    files, folder = _file_system(spark, path)
    files.deleteOnExit(folder)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)


def drop_all(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. Frames that still read one can no longer be used."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        files, folder = _file_system(spark, path)
        files.delete(folder, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` as a table in the shared folder, read back: later stages survive the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
