"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the workers, once for each application.

    The driver serves the archive to executors, so they need neither the folder nor a PYTHONPATH.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    handle, path = tempfile.mkstemp(prefix="larder-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted([*(ROOT / "larder").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]):
            out.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
