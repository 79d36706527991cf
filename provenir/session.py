"""Sessions with the settings that the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str, cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``cpus`` asks for local mode (tests, benchmarks)."""
    builder = SparkSession.builder.appName(name)
    if cpus:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
