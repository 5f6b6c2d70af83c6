"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def make_session(app: str = "folioflow", **conf: str) -> SparkSession:
    """UTC, adaptive execution, right-wins map merges; anything else is left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
