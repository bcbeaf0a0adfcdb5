"""Session helper used by the tests, bench and examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "gritstone", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution and a UTC clock."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRITSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
