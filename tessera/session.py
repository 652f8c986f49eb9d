"""Making the package importable on executors, however the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, once a Spark context; they need it wherever a function of it runs."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f"{ROOT.name}/{f.relative_to(ROOT)}")
    sc.addPyFile(path)
    sc._tessera_shipped = True
