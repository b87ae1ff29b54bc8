"""The folder that driver and executors share for intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a temporary one if driver and executors are one process; else an error, as
    no machine-local folder can be read by other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return _own_folder[context.applicationId]
