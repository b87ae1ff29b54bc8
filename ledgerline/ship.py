"""Gives Python workers this package, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once."""
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="ledgerline-code-")) / "ledgerline_core.zip"
    with zipfile.ZipFile(where, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(where))
    _shipped["to"] = context.applicationId
