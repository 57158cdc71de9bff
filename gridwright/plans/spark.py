"""Small helpers for tests and tools."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", name: str = "gridwright", **conf: str) -> SparkSession:
    """A local session with what the engine expects of any: UTC and adaptive execution."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
