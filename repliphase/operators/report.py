"""The data behind figures and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.functions import ranks, stats
from repliphase.operators import similarity


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows (bin, n) of the values within the limits, all bins present; the last bin is closed."""
    v = F.col(value).cast("double")
    place = F.least(F.floor((v - low) / (high - low) * bins).cast("long"), F.lit(bins - 1).cast("long"))
    found = df.where((v >= low) & (v <= high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def similarity_decay(occ: DataFrame, block_of: DataFrame, order: DataFrame, bins: int = 40) -> DataFrame:
    """Rows (bin, n, phi): the mean similarity of pairs by their distance in the order, as ``timing.total_order`` gives it."""
    return similarity.pair_decay(occ, block_of, order, bins)


def robinson_score(occ: DataFrame, block_of: DataFrame, order: DataFrame) -> DataFrame:
    """One row (rho, n): how well similarity falls with distance, as a rank correlation over landmark pairs."""
    return similarity.pair_rank_correlation(occ, block_of, order, 50)


def evenly_spaced(cells: DataFrame, order: str, cap: int) -> DataFrame:
    """All cells up to ``cap``, else ``cap`` of them at even ranks, first and last among them; for display."""
    n = cells.count()
    if n <= cap:
        return cells
    ranked = ranks.numbered(cells, [order], "_r").withColumn("_r", F.col("_r") - 1)
    wanted = cells.sparkSession.range(cap).select(F.rint(F.col("id") * ((n - 1) / max(cap - 1, 1))).cast("long").alias("_r")).distinct()
    return ranked.join(wanted, "_r", "left_semi").drop("_r")


def percentiles(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (name, p05, median, p95) of the values that are neither missing nor NaN."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.*")
    ok = long.where("v is not null and not isnan(v)")
    return ok.groupBy("name").agg(F.percentile("v", F.lit(0.05)).alias("p05"), F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.95)).alias("p95"))


def confounding(cells: DataFrame, progression: str, names: list[str]) -> DataFrame:
    """Rows (name, rho, n): rank correlations of the order with technical measures."""
    out = None
    for c in names:
        row = stats.spearman(cells, progression, c).select(F.lit(c).alias("name"), "rho", "n")
        out = row if out is None else out.union(row)
    return out
