"""Registered queries: each is an operator applied to whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def re2(pattern: str) -> str:
    """A pattern as a literal of DuckDB's SQL, whose engine knows no u flag."""
    return "'" + pattern.replace("(?iu)", "(?i)").replace("\\/", "/").replace("'", "''") + "'"
