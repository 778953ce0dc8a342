"""A session with the settings the transforms rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: object) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is left to the cluster's configuration."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    return builder.config(map={k: str(v) for k, v in settings.items()}).getOrCreate()
