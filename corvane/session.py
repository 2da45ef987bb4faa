"""What a Spark session needs to run the operators' Python functions on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context; they need no copy of their own."""
    sc = spark.sparkContext
    if not getattr(sc, "_corvane_shipped", False):
        top = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(packed))
        sc._corvane_shipped = True
    return spark
