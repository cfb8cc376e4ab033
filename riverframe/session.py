"""Session defaults shared by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "riverframe", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with the settings that the library is tested with; on a cluster pass your own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
