"""The package for the Python workers: executors need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Applications that have been given the package.
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once; Spark's own file server hands them to the executors."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="package-"), "skyquilt_package.zip"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("skyquilt", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)
