"""A session with the settings that the library's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, since dates without a zone are read in the session's; adaptive plans, which split skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "tarnwork", master: str | None = None, **more: str) -> SparkSession:
    """Sizes of partitions and memory are the cluster's business and stay as they are set there."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
