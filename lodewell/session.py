"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodewell", **settings) -> SparkSession:
    """UTC, adaptive execution with skew joins; what a cluster sizes (memory, partitions) is left to its configuration."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
