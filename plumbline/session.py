"""A session with the settings that this engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "plumbline", **conf: str) -> SparkSession:
    """AQE sizes the shuffles; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the JVM never compiles a method over 8,000 bytes: such a stage is faster without code of its own
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
