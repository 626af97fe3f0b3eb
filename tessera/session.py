"""A Spark session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **config: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC; keyword names use __ for dots."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (fixed | {k.replace("__", "."): v for k, v in config.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
