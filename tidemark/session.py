"""Spark session with the settings the operators were planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Exchange-local wall-clock is kept as TIMESTAMP_NTZ everywhere, so no result
# depends on the session time zone; UTC is only a neutral default.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **overrides: str) -> SparkSession:
    """Create (or reuse) a session; a cluster's own master and settings win when set."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
