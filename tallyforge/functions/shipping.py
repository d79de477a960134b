"""The package for Python workers: executors that don't have it installed get it from the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        path = Path(tempfile.mkdtemp(prefix="tallyforge-ship-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
