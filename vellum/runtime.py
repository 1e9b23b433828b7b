"""Makes the package importable in Python workers wherever the session runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers once per Spark context (a small zip through Spark's own file server)."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vellum-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file as long as the driver runs
    at = os.path.join(folder, "vellum_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"vellum/{p.relative_to(top)}")
    sc.addPyFile(at)
    sc._vellum_shipped = True
    return spark
