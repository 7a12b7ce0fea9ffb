"""Giving the executors this package, for sessions that were not started with ``--py-files``."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package as a zip to the Python workers of the session, once per application.

    The zip lies in the driver's working folder; Spark hands it to every executor, also to those that start later.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.abspath(f"tidemark-{context.applicationId}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
