"""Session settings the library expects; every one is a stock Spark option."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # Run-time re-planning: coalesces small shuffle partitions, splits skewed
    # ones and turns joins into broadcasts once real sizes are known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Event times are wall-clock text; one fixed zone keeps every hop consistent.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "ledgerlake", **overrides: str) -> SparkSession:
    """Get or create a session with the library defaults.

    Nothing here names a master or sizes a cluster: those come from
    ``spark-submit``.  Pass dotted options with ``__`` for the dots.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = DEFAULTS | {key.replace("__", "."): value for key, value in overrides.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
