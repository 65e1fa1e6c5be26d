"""Session helper for scripts and tests; queries themselves accept any session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "factloom", cpus: str | int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the results depend on (UTC, ANSI defaults) and small shuffles."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FACTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
