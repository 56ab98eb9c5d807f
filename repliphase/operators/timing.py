"""Progression of cells and the replication-timing track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions import ranks, stats


def total_order(cells: DataFrame, order: list[str], alias: str = "progression") -> DataFrame:
    """``cells`` with progression (rank - 0.5)/n and global_order (rank from 1)."""
    rows = ranks.numbered(ranks.with_count(cells, "_n"), order, "global_order")
    return rows.withColumn(alias, (F.col("global_order") - F.lit(0.5)) / F.col("_n")).drop("_n")


def tiles(cells: DataFrame, by: str, n: int, alias: str = "pseudotime_bin") -> DataFrame:
    """``cells`` in n groups of near-equal count along ``by``, the larger ones first."""
    rows, at = ranks.numbered(ranks.with_count(cells, "_n"), [by], "_place"), F.col("_place") - 1
    size, more = F.floor(F.col("_n") / n), F.col("_n") % n
    large = more * (size + 1)
    tile = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1))))
    return rows.withColumn(alias, (tile + 1).cast("int")).drop("_n", "_place")


def orientation(cells: DataFrame, progression: str, anchor: str, anchor_high: str = "early", flip: bool = False) -> tuple[bool, float | None]:
    """Whether the axis turns, and the correlation of progression with the anchor before that."""
    rho = stats.spearman(cells, progression, anchor).first().rho
    turn = False if rho is None else (rho > 0 if anchor_high == "early" else rho < 0)
    return turn != flip, rho


def shrunk_means(cell_bins: DataFrame, progression: DataFrame, bins: DataFrame, shrink: float = 3.0) -> DataFrame:
    """Rows (h, bin, raw, support): the mean progression of the distinct cells in each bin, drawn to the overall mean."""
    prior = progression.agg(F.avg("progression").alias("_prior"))
    held = cell_bins.select("cell", "h", "bin").distinct().join(progression.select("cell", "progression"), "cell")
    sums = held.groupBy("h", "bin").agg(F.sum("progression").alias("_s"), F.count("*").alias("_c"))
    rows = bins.select("h", "bin").join(sums, ["h", "bin"], "left").crossJoin(prior)  # prior: one row
    c = F.coalesce("_c", F.lit(0))
    return rows.select("h", "bin", ((F.coalesce("_s", F.lit(0.0)) + shrink * F.col("_prior")) / (c + F.lit(float(shrink)))).alias("raw"), c.cast("long").alias("support"))


def running_median(track: DataFrame, width: int, window: int, value: str = "raw", alias: str = "smooth") -> DataFrame:
    """The median of all bins of the chromosome that start within ``window`` of a bin's start, both ends included."""
    by = Window.partitionBy("h").orderBy(F.col("bin") * width).rangeBetween(-window, window)
    return track.withColumn(alias, F.percentile(value, F.lit(0.5)).over(by) if window > 0 else F.col(value))


def bedgraph(track: DataFrame, chroms: DataFrame, width: int, value: str = "smooth") -> DataFrame:
    """Rows (chrom, s, e, value) of supported bins; the last bin ends with its chromosome."""
    rows = track.where(f"support > 0 and {value} is not null and not isnan({value})").join(chroms, "h")
    return rows.select(F.col("name").alias("chrom"), (F.col("bin") * width).alias("s"), F.least((F.col("bin") + 1) * width, F.col("size")).alias("e"), F.col(value).alias("value"))
