"""Sessions, and how executors get this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="skerry-package-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "skerry-package"), "zip", ROOT, "skerry"))
    _shipped.add(app)


def shipping(query):
    """``query`` after the package has been sent."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
