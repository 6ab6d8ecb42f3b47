"""What a session needs before Python functions of this package run in its workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per context, unless they inherit it through PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_ledgerlens_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="ledgerlens-")) / "ledgerlens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "ledgerlens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    context._ledgerlens_shipped = True
