"""One place for session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "millrace", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC dates, adaptive execution and skew-join splitting; ``extra`` settings win."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate()
