"""Session builder with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodemap", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; shuffle partitions are left to adaptive coalescing."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
