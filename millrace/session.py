"""A session with the settings that the library's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive plans; all else as the cluster has it or as given (dots as __)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
