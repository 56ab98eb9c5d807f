"""Ranks and quantiles over whole DataFrames, without a task that sees all rows.

Rows are dealt over range partitions of their order and checkpointed, so that partitions stay what
they are. Within each they are summed by themselves, and moved by the total of the partitions before
it, of which there is a row each. Equal rows of the order may be many: what ranks by value works on distinct
values with their counts, which are combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions.storage import settled


def running_total(df: DataFrame, order: list, value: str | None = None, alias: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` (or the count) over all rows before it in this order; the order should be total."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.lit(1).cast("long") if value is None else F.col(value)
    dealt = settled(df.repartitionByRange(tasks, *order).withColumns({"_part": F.spark_partition_id(), "_size": size}))
    parts = dealt.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(parts, "_part")
    return out.withColumn(alias, F.col("_before") + F.col("_inside")).drop("_part", "_size", "_inside", "_before")


def numbered(df: DataFrame, order: list, alias: str) -> DataFrame:
    """``df`` with its row's number in this order, from 1."""
    return running_total(df, order, None, alias).withColumn(alias, (F.col(alias) + 1).cast("long"))


def with_count(df: DataFrame, alias: str) -> DataFrame:
    """``df`` with its number of rows."""
    return df.crossJoin(df.agg(F.count(F.lit(1)).alias(alias)))  # one row


def average_ranks(df: DataFrame, value: str, alias: str) -> DataFrame:
    """``df`` with the mean rank, from 1, that equal values share; values are not null."""
    counts = running_total(df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n")), ["_value"], "_n", "_lower")
    mean = counts.select("_value", (F.col("_lower") + (F.col("_n") + 1) / F.lit(2.0)).alias(alias))
    return df.join(mean, F.col(value) == F.col("_value")).drop("_value")


def quantiles(df: DataFrame, value: str, probabilities: list[float], weight: str | None = None) -> DataFrame:
    """One row q0, q1, ...: exact quantiles with linear interpolation, NULL of no values.

    From distinct values and the counts below them those at the wanted places are picked; rows without a value count for
    nothing.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_value")).agg(times.cast("long").alias("_n"))
    counts = running_total(counts, ["_value"], "_n", "_lower")
    total = counts.agg(F.sum("_n").alias("_total"))
    rows = counts.crossJoin(total)  # one row

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_lower") <= place) & (place < F.col("_lower") + F.col("_n")), F.col("_value")))

    place = [F.lit(float(p)) * (F.col("_total") - 1) for p in probabilities]
    picked = rows.agg(F.max("_total").alias("_total"), *[at(near(p)).alias(f"{name}{k}") for k, p in enumerate(place) for name, near in (("_a", F.floor), ("_b", F.ceil))])
    share = [p - F.floor(p) for p in place]
    return picked.select(*[(F.col(f"_a{k}") + s * (F.col(f"_b{k}") - F.col(f"_a{k}"))).alias(f"q{k}") for k, s in enumerate(share)])


def median_and_mad(df: DataFrame, value: str) -> DataFrame:
    """One row (med, sd, mad): the median, the standard deviation, and the median distance from the median."""
    middle = quantiles(df, value, [0.5]).select(F.col("q0").alias("med"))
    away = quantiles(df.crossJoin(middle).withColumn("_away", F.abs(F.col(value) - F.col("med"))), "_away", [0.5])  # middle: one row
    return middle.crossJoin(df.agg(F.stddev_pop(value).alias("sd"))).crossJoin(away.select(F.col("q0").alias("mad")))  # one row each

