"""Spark-first analytics for single-cell replication data."""

__version__ = "0.1.0"
