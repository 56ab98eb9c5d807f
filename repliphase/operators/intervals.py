"""Interval operators: merging, point hits and overlaps with bins. Intervals are half-open (h, s, e)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 17


def merge(intervals: DataFrame) -> DataFrame:
    """Disjoint intervals (h, s, e); touching ones become one."""
    by = Window.partitionBy("h").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where("e > s").withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    grouped = marked.withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("h", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def _bucketed(intervals: DataFrame, bucket: int) -> DataFrame:
    return intervals.select(F.col("h").alias("_h"), "s", "e", F.explode(F.expr(f"sequence(s div {bucket}, (e - 1) div {bucket})")).alias("_b"))


def flag_hits(events: DataFrame, merged: DataFrame, alias: str = "hit", bucket: int = BUCKET) -> DataFrame:
    """``events`` (h, p) with whether p lies in an interval; the intervals must be disjoint.

    Both sides meet on chromosome and bucket, an equi-join that needs no broadcast.
    """
    spans = _bucketed(merged, bucket)
    on = (F.col("h") == F.col("_h")) & (F.expr(f"p div {bucket}") == F.col("_b")) & (F.col("s") <= F.col("p")) & (F.col("p") < F.col("e"))
    return events.join(spans, on, "left").withColumn(alias, F.col("s").isNotNull()).drop("_h", "s", "e", "_b")


def outside(events: DataFrame, merged: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The events that lie in no interval."""
    spans = _bucketed(merged, bucket)
    on = (F.col("h") == F.col("_h")) & (F.expr(f"p div {bucket}") == F.col("_b")) & (F.col("s") <= F.col("p")) & (F.col("p") < F.col("e"))
    return events.join(spans, on, "left_anti")


def _overlaps(intervals: DataFrame, chroms: DataFrame, width: int, *more: str) -> DataFrame:
    """Rows (h, bin, overlap, more...): each interval against each bin that it touches; bins beyond the ends are clamped."""
    sizes = chroms.select("h", F.expr(f"greatest(1L, (cast(size as long) + {width} - 1) div {width})").alias("_n"))
    rows = intervals.where("e > s").join(sizes, "h")
    rows = rows.withColumn("bin", F.explode(F.expr(f"sequence(least(greatest(s div {width}, 0L), _n - 1), least(greatest((e - 1) div {width}, 0L), _n - 1))")))
    return rows.select("h", "bin", F.expr(f"greatest(0L, least(e, (bin + 1) * {width}) - greatest(s, bin * {width}))").alias("overlap"), *more)


def bin_fraction(chroms: DataFrame, merged: DataFrame, width: int) -> DataFrame:
    """Rows (h, bin, fraction) of touched bins: the covered share of a full bin, 1 at most."""
    found = _overlaps(merged, chroms, width).groupBy("h", "bin").agg(F.sum("overlap").alias("o"))
    return found.where("o > 0").select("h", "bin", F.least(F.col("o") / F.lit(float(width)), F.lit(1.0)).alias("fraction"))


def bin_means(chroms: DataFrame, track: DataFrame, width: int) -> DataFrame:
    """Rows (h, bin, value): the mean of a track (h, s, e, value), weighted by overlap; bins without any are left out."""
    found = _overlaps(track, chroms, width, "value").groupBy("h", "bin").agg(F.sum(F.col("value") * F.col("overlap")).alias("v"), F.sum("overlap").alias("o"))
    return found.where("o > 0").select("h", "bin", (F.col("v") / F.col("o")).alias("value"))
