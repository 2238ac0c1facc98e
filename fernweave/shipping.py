"""Sends this package to the executors' Python workers, so that a cluster need not have it installed."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's sources, served to the executors by the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fernweave-")), "fernweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(out)
    _SENT.add(sc.applicationId)


def shipped(fn):
    """A query or pipeline stage (its first argument is the session) that ships the package first."""

    @functools.wraps(fn)
    def run(spark, *args):
        ship(spark)
        return fn(spark, *args)

    return run
