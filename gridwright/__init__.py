"""Spark-first engine that turns semi-structured documents into checkable tables."""

__version__ = "0.1.0"
