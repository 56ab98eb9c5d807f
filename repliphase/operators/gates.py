"""Quality gates of cells: one status each, by precedence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repliphase.functions import stats

#: Every status with its reason.
REASONS = {
    "PASS": "",
    "NO_FRAGMENTS": "no fragment outside the blacklist",
    "BREADTH_OVERSAT_FAIL": "occupies too many bins",
    "QC_FAIL_EMPTY": "occupies almost no bins",
    "BREADTH_SPARSE_FAIL": "occupies too few bins",
    "DEPTH_FAIL": "too few or too many fragments",
    "LOW_EVENTS_FAIL": "too few foreground events",
    "DISPERSED_FAIL": "too few events in tracts",
    "NO_STRUCTURE_FAIL": "no neighbours in similarity",
    "LOW_INFO_FAIL": "too few informative blocks",
    "UNPLACEABLE_FAIL": "no place in the order",
}


@dataclass(frozen=True)
class Gates:
    min_fragments: int = 1000
    depth_low: float = 0.01
    depth_high: float = 0.99
    hard_floor: float = 0.1
    min_floor: float = 0.1
    mad_k: float = 3.0
    breadth_max: float = 0.7
    min_events: int = 200
    min_signal: float = 0.1
    pool_least: int = 50


def thresholds(cells: DataFrame, g: Gates) -> DataFrame:
    """One row (depth_lo, depth_hi, cut) from cells with log_depth, n and breadth."""
    q = stats.quantiles(cells, "log_depth", [g.depth_low, g.depth_high]).withColumnsRenamed({"q0": "depth_lo", "q1": "depth_hi"})
    rows = cells.crossJoin(q)  # one row
    inner = (F.col("breadth") >= g.hard_floor) & (F.col("breadth") < g.breadth_max) & _depth_ok(g)
    size = rows.agg(F.count_if(inner).alias("_pool"))
    pool = rows.crossJoin(size).where(F.when(F.col("_pool") >= g.pool_least, inner).otherwise(F.col("breadth") > 0))
    mad = stats.robust_mad(pool, "breadth")
    return q.crossJoin(mad).select("depth_lo", "depth_hi", F.greatest(F.lit(float(g.min_floor)), F.col("med") - g.mad_k * F.col("scale")).alias("cut"))


def _depth_ok(g: Gates) -> Column:
    return (F.col("log_depth") >= F.col("depth_lo")) & (F.col("log_depth") <= F.col("depth_hi")) & (F.col("n") >= g.min_fragments)


def status(cells: DataFrame, g: Gates) -> DataFrame:
    """``cells`` (n, log_depth, breadth, n_signal, frac_signal) with status and reason."""
    rows = cells.crossJoin(thresholds(cells, g))  # one row
    value = (
        F.when(F.col("breadth") >= g.breadth_max, "BREADTH_OVERSAT_FAIL")
        .when(F.col("breadth") < g.hard_floor, "QC_FAIL_EMPTY")
        .when(F.col("breadth") < F.col("cut"), "BREADTH_SPARSE_FAIL")
        .when(~_depth_ok(g), "DEPTH_FAIL")
        .when(F.coalesce("n_signal", F.lit(0)) < g.min_events, "LOW_EVENTS_FAIL")
        .when(F.coalesce("frac_signal", F.lit(0.0)) < g.min_signal, "DISPERSED_FAIL")
        .otherwise("PASS")
    )
    return with_reason(rows.withColumn("status", value)).drop("depth_lo", "depth_hi", "cut")


def with_reason(rows: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return rows.withColumn("reason", table[F.col("status")])


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows (status, n) of every status, zero where no cell has it."""
    names = rows.sparkSession.createDataFrame([(s,) for s in REASONS], "status string")
    return names.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def structure_status(rows: DataFrame, min_excess: float, min_z: float, min_valid: int) -> DataFrame:
    """``rows`` (excess, z, valid_blocks) with NO_STRUCTURE_FAIL, LOW_INFO_FAIL or PASS; a missing excess fails."""
    ok = F.lit(True)
    if min_excess > 0:
        ok = ok & F.coalesce(F.col("excess") >= min_excess, F.lit(False))
    if min_z > 0:
        ok = ok & F.coalesce(F.col("z") >= min_z, F.lit(False))
    return rows.withColumn("status", F.when(~ok, "NO_STRUCTURE_FAIL").when(F.coalesce("valid_blocks", F.lit(0)) < min_valid, "LOW_INFO_FAIL").otherwise("PASS"))
