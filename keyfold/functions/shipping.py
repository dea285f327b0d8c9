"""Puts this package on the executors, for the operators that run Python there."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from keyfold.functions import shared

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, as an archive in the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared.shared_dir(spark)}/keyfold-{app}.zip"
    shared.write_bytes(spark, path, data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
