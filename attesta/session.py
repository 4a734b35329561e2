"""The session every job of the engine runs in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "attesta", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive; anything else is the cluster's to say."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
