"""A session with the settings that the library's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ``InferFiltersFromGenerate`` would copy a whole detection expression into a filter below the shuffle, so that every
#: pattern runs two or three times.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The session, made with :data:`SETTINGS` and then ``settings`` (dots as double underscores)."""
    builder = SparkSession.builder.appName("veilscan")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
