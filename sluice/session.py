"""Session defaults shared by the tests, the benchmark and small programs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "sluice", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
