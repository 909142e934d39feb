"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path doesn't hold it already; once an application."""
    context = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or getattr(context, "_statefold_shipped", False):
        return
    made = Path(tempfile.mkdtemp(prefix="statefold-ship-")) / "statefold_package.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in [*ROOT.glob("*.py"), *ROOT.glob("statefold/**/*.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(made))
    context._statefold_shipped = True
