"""Sessions: settings that suit the engine, and the package sent to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Settings that the plans count on; a cluster's own values win where they are set already.
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def build(name: str = "graphloom", **more: str) -> SparkSession:
    """A session with SETTINGS; keyword names have _ for the dots of Spark's names."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> str:
    """Sends the package to all executors as a zip; the zip's path on the driver."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    return path
