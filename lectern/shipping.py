"""Sends the package to the executors.

Functions that run in Python workers are found there by import.  Where workers
share the driver's machine and its PYTHONPATH names the package, nothing is
needed; else the package goes with the job as a ZIP file.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)


def _sources() -> list[str]:
    return sorted(os.path.join(d, f) for d, _, files in os.walk(HERE) for f in files if f.endswith(".py"))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    sc._lectern_shipped = True
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in known and (sc.master or "").startswith("local"):
        return
    digest = hashlib.sha256()
    for f in _sources():
        with open(f, "rb") as src:
            digest.update(src.read())
    folder = tempfile.mkdtemp()  # the driver's own; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, f"lectern-{digest.hexdigest()[:12]}.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in _sources():
            z.write(f, os.path.relpath(f, ROOT))
    sc.addPyFile(at)  # served by the driver to every executor
