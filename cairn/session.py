"""A session with the settings that the operators are tuned for."""
from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cairn", **settings: str) -> SparkSession:
    """Adaptive execution with skew-join handling and UTC; settings override, with dots as double underscores."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    conf |= {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
