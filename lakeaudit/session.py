"""The session the library is tested and benchmarked with; on a cluster, any session with these SQL settings will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lakeaudit", master: str | None = None, shuffle_partitions: int | None = None, memory: str = "6g") -> SparkSession:
    """UTC, ANSI and adaptive execution; partitions and memory are for a local master and are left alone on a cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
