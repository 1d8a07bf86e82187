"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lexspark", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; further settings by keyword with dots as underscores' pairs in ``conf``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
