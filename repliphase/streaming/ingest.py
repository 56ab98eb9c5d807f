"""Counts that can be kept up as fragments arrive: depth and bin counts of cells.

Everything from the gates on needs quantiles over all cells and stays a batch matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_depth(events: DataFrame) -> DataFrame:
    """Rows (cell, n) of a stream or table of events; for update or complete output."""
    return events.groupBy("cell").agg(F.count("*").alias("n"))


def running_bins(events: DataFrame, width: int) -> DataFrame:
    """Rows (cell, h, bin, n) of a stream or table of events (cell, h, p)."""
    return events.groupBy("cell", "h", F.expr(f"p div {width}").alias("bin")).agg(F.count("*").alias("n"))


def start_depth(events: DataFrame, name: str, checkpoint: str):
    """Keeps the depth of a stream of events in the in-memory table ``name``."""
    return running_depth(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
