"""Make the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import cohortlens


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to every executor, once per Spark application.

    The archive is written on the driver and handed to ``addPyFile``, which serves it to
    running and later executors; no worker reads a driver folder.
    """
    context = spark.sparkContext
    if getattr(context, "_cohortlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(cohortlens.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cohortlens-package-"), "cohortlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("cohortlens", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._cohortlens_shipped = True
