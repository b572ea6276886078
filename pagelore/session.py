"""Sessions, and the package's way to the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Settings that suit the library; a cluster's own take their place.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "pagelore", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a context, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_pagelore_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="pagelore-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file until it ends
    path = os.path.join(folder, "pagelore-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for inner, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(at := os.path.join(inner, name), os.path.relpath(at, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._pagelore_shipped = True
