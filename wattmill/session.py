"""Session settings that the library's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "wattmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with ANSI SQL and adaptive execution. On a cluster leave `master` and `shuffle_partitions` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
