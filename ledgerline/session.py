"""A session with the settings that the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerline", **extra: str) -> SparkSession:
    """Adaptive execution does what depends on run-time sizes: coalescing, skewed joins, join choice."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | extra).getOrCreate()
