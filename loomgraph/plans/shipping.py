"""Makes the package importable in Python workers whose path does not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application, unless PYTHONPATH has its folder already."""
    if ROOT in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "loomgraph")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    _done.add(context.applicationId)
