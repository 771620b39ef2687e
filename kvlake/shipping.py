"""Makes this package importable in the Python workers of any cluster.

Executors share no folder with the driver, so the package travels through
Spark's own file server (``addPyFile``); a replacement executor fetches it
again when it starts.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref

from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers once for each Spark context."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kvlake-ship-")
    try:
        staged = os.path.join(folder, "tree")
        shutil.copytree(
            root,
            os.path.join(staged, os.path.basename(root)),
            ignore=shutil.ignore_patterns("__pycache__", "*.pyc"),
        )
        archive = shutil.make_archive(os.path.join(folder, "kvlake_workers"), "zip", staged)
        sc.addPyFile(archive)
    finally:
        shutil.rmtree(os.path.join(folder, "tree"), ignore_errors=True)
    _SHIPPED.add(sc)
