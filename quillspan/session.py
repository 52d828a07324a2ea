"""Session defaults; a cluster's own settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "quillspan", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on, whose workers know this package."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = builder.config(map=defaults | settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> str:
    """Send this package to the workers, which need it wherever it isn't installed; the archive's path on the driver."""
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="quillspan-ship-"), "quillspan.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(name)
    return name
