"""Rank, robust and quantile statistics over DataFrames; missing values are NULL.

Ranks and quantiles over a whole DataFrame are those of ``ranks``; within keys they are windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions import ranks
from repliphase.functions.storage import settled


def _over(partition: list[str]) -> Window:
    return Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))


def unit_rank(df: DataFrame, order: list, alias: str = "rank01", partition: list[str] = ()) -> DataFrame:
    """Ranks from 0 to 1 in this order, ties broken by the later columns; 0 for a single row."""
    if not partition:
        rows = ranks.numbered(ranks.with_count(df, "_n"), order, "_r")
        return rows.withColumn(alias, F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise((F.col("_r") - 1) / (F.col("_n") - 1))).drop("_n", "_r")
    own = _over(list(partition))
    n = F.count("*").over(own)
    return df.withColumn(alias, F.when(n <= 1, F.lit(0.0)).otherwise((F.row_number().over(own.orderBy(*order)) - 1) / (n - 1)))


def average_rank(value: str, partition: list[str]) -> Column:
    """The mean rank of equal values within keys, from 1."""
    own = _over(list(partition))
    same = Window.partitionBy(*partition, value)
    return F.rank().over(own.orderBy(value)) + (F.count("*").over(same) - 1) / F.lit(2.0)


def spearman(df: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """One row (rho, n): rank correlation of the rows where both are finite; NULL for fewer than ``least``."""
    both = finite(df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), "a", "b")
    ranked = ranks.average_ranks(ranks.average_ranks(settled(both), "a", "ra"), "b", "rb")
    n, size = F.count("*"), F.stddev_pop("ra") * F.stddev_pop("rb")
    return ranked.agg(F.when(n >= least, F.covar_pop("ra", "rb") / F.nullif(size, F.lit(0.0))).alias("rho"), n.alias("n"))


def finite(df: DataFrame, *names: str) -> DataFrame:
    """The rows where all of these are neither NULL, NaN nor infinite."""
    for c in names:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def robust_mad(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Rows (keys..., med, scale): the median, and the first positive of 1.4826 MAD, standard deviation and 1e-9."""
    keys = list(keys)
    v = finite(df.select(*keys, F.col(value).cast("double").alias("v")), "v")
    if keys:
        med = v.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("med"), F.stddev_pop("v").alias("sd"))
        out = v.join(med, keys).groupBy(*keys, "med", "sd").agg(F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5)).alias("mad"))
    else:
        out = ranks.median_and_mad(settled(v), "v").where("med is not null")
    out = out.withColumn("mad", F.col("mad") * 1.4826)
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1e-9))
    return out.select(*keys, "med", scale.alias("scale"))


def quantiles(df: DataFrame, value: str, probabilities: list[float], few: bool = False) -> DataFrame:
    """One row q0, q1, ...: exact quantiles with linear interpolation; ``few`` says that one task may hold the distinct values."""
    if few:
        return df.agg(*[F.percentile(value, F.lit(float(p))).alias(f"q{k}") for k, p in enumerate(probabilities)])
    return ranks.quantiles(df, value, probabilities)


def log10_histogram(df: DataFrame, value: str, step: float = 0.025, top: float = 6.0) -> DataFrame:
    """Rows (bin, n) of log10(value) on [0, top], all bins present; the last bin is closed."""
    bins = round(top / step)
    log = F.log10(F.col(value).cast("double"))
    found = df.where((F.col(value) > 0) & (log <= top)).groupBy(F.least(F.floor(F.round(log / F.lit(step), 9)).cast("long"), F.lit(bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def gaussian_smooth(hist: DataFrame, sigma: float, index: str = "bin", value: str = "n") -> DataFrame:
    """Rows (bin, smooth): the value convolved with a normal kernel of radius 3 sigma, zero beyond both ends."""
    radius = math.ceil(3 * sigma)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(k - radius).alias("d"), F.lit(w / sum(raw)).alias("w")) for k, w in enumerate(raw)])
    spread = hist.select(F.col(index).alias("i"), F.col(value).alias("v"), F.explode(kernel).alias("k"))
    out = spread.groupBy((F.col("i") + F.col("k.d")).alias(index)).agg(F.sum(F.col("v") * F.col("k.w")).alias("smooth"))
    return out.join(hist.select(index), index, "left_semi")


def reduce_replicates(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, n_used, sd, lo10, hi90) of the finite values of each key."""
    v = df.select(key, F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double")).alias("v"))
    return v.groupBy(key).agg(F.count("v").alias("n_used"), F.stddev_pop("v").alias("sd"), F.percentile("v", F.lit(0.1)).alias("lo10"), F.percentile("v", F.lit(0.9)).alias("hi90"))


def quantile_map(pairs: DataFrame, x: str, y: str, queries: DataFrame, q: str, alias: str = "mapped", min_pairs: int = 20, keys: list[str] = ()) -> DataFrame:
    """``queries`` with ``q`` mapped from the distribution of x to that of y, for each of the ``keys`` by itself.

    Knots pair the sorted x with the sorted y, equal x sharing their mean y. Between knots the map
    is linear, beyond the ends it goes on with the end slopes. With fewer than ``min_pairs`` pairs
    it is the identity, with a single knot a constant. Sorting is dealt over range partitions of keys and value;
    a query's knot is found by its number, the count of knots at or before it, so no task holds a whole key.
    """
    keys = list(keys)
    both = settled(finite(pairs.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), "__x", "__y"))
    # Each key has as many x as y, so that numbers over all keys pair them as those within a key would.
    xs = ranks.numbered(both, [*keys, "__x", "__y"], "__r").select(*keys, "__x", "__r")
    ys = ranks.numbered(both, [*keys, "__y", "__x"], "__r").select(*keys, "__y", "__r")
    knots = xs.join(ys, [*keys, "__r"]).groupBy(*keys, "__x").agg(F.avg("__y").alias("__y"), F.count("*").alias("__n"))
    knots = settled(ranks.numbered(knots, [*keys, "__x"], "__k"))
    after = knots.select(*keys, (F.col("__k") - 1).alias("__k"), F.col("__x").alias("__x2"), F.col("__y").alias("__y2"))
    slope = (F.col("__y2") - F.col("__y")) / F.greatest(F.col("__x2") - F.col("__x"), F.lit(1e-12))
    lines = knots.join(after, [*keys, "__k"], "left").select(*keys, "__k", "__x", "__y", F.coalesce(slope, F.lit(0.0)).alias("__slope"))

    value = F.when(F.isnan(F.col(q).cast("double")), None).otherwise(F.col(q).cast("double"))
    asked = queries.withColumns({"__at": value, "__asks": F.lit(True), "__one": F.lit(0), "__tie": F.monotonically_increasing_id()})
    held = knots.select(*keys, F.col("__x").alias("__at"), F.lit(False).alias("__asks"), F.lit(1).alias("__one"))
    rows = asked.unionByName(held, allowMissingColumns=True)
    rows = ranks.running_total(rows, [*keys, "__at", "__asks", "__tie"], "__one", "__before").where("__asks")
    bounds = knots.groupBy(*keys).agg(F.min("__k").alias("__first"), F.max("__k").alias("__last"), F.sum("__n").alias("__pairs"))
    if keys:
        rows = rows.join(bounds, keys, "left")
    else:
        rows = rows.withColumns({c: F.lit(v).cast("long") for c, v in bounds.first().asDict().items()})
    # From the last knot on the line before it holds.
    rows = rows.withColumn("__k", F.least(F.greatest("__before", "__first"), F.greatest(F.col("__last") - 1, "__first"))).join(lines, [*keys, "__k"], "left")
    mapped = F.when(F.coalesce("__pairs", F.lit(0)) < min_pairs, F.col("__at")).otherwise(F.col("__y") + F.col("__slope") * (F.col("__at") - F.col("__x")))
    return rows.withColumn("__mapped", mapped).select(*[c for c in queries.columns if c != alias], F.col("__mapped").alias(alias))


def binned_baseline(df: DataFrame, statistic: str, support: str, n_bins: int = 20, min_n: int = 25) -> DataFrame:
    """Knots (centre, mean, sd) of a statistic along log10(support): medians and robust scales of bins of equal count.

    Too few rows, or fewer than two bins, give one knot over all rows.
    """
    rows = finite(df.select(F.col(statistic).cast("double").alias("y"), F.col(support).cast("double").alias("s")), "y", "s").where("s > 0").select("y", F.log10("s").alias("x"))
    n = rows.count()

    def whole() -> DataFrame:
        return robust_mad(rows, "y").select(F.lit(0.0).alias("centre"), F.col("med").alias("mean"), F.col("scale").alias("sd"))

    if n < max(3 * min_n, 60):
        return whole()
    bins = max(3, min(n_bins, n // min_n))
    ranked = ranks.numbered(rows, ["x", "y"], "r").withColumn("r", F.col("r") - 1)
    # Bin b holds the ranks from floor(b n / bins) on.
    ranked = ranked.withColumn("b", F.expr(f"least({bins - 1}, ((r + 1) * {bins} - 1) div {n})"))
    stats = robust_mad(ranked, "y", ["b"]).join(ranked.groupBy("b").agg(F.percentile("x", F.lit(0.5)).alias("centre"), F.count("*").alias("n")), "b").where("n >= 5")
    knots = stats.select("centre", F.col("med").alias("mean"), F.col("scale").alias("sd"))
    return knots if stats.count() >= 2 else whole()


def along_baseline(df: DataFrame, support: str, knots: DataFrame, mean: str = "null_mean", sd: str = "null_sd") -> DataFrame:
    """``df`` with the baseline at its support: linear between knots, constant beyond both ends."""
    order = Window.partitionBy(F.lit(0)).orderBy("centre")
    inf = float("inf")
    nxt = {c: F.lead(c).over(order) for c in ("centre", "mean", "sd")}
    prior = F.lag("centre").over(order)
    k = knots.select("centre", "mean", "sd", *[v.alias(c + "2") for c, v in nxt.items()], prior.isNull().alias("first"))
    inner = k.select(F.col("centre").alias("lo"), F.coalesce("centre2", F.lit(inf)).alias("hi"), "centre", "centre2", "mean", "mean2", "sd", "sd2")
    below = k.where("first").select(F.lit(-inf).alias("lo"), F.col("centre").alias("hi"), "centre", F.lit(None).cast("double").alias("centre2"), "mean", F.lit(None).cast("double").alias("mean2"), "sd", F.lit(None).cast("double").alias("sd2"))
    spans = inner.union(below)
    out = df.withColumn("_x", F.log10(F.greatest(F.col(support).cast("double"), F.lit(1.0)))).join(F.broadcast(spans), (F.col("_x") >= F.col("lo")) & (F.col("_x") < F.col("hi")), "left")  # at most n_bins + 1 spans
    share = (F.col("_x") - F.col("centre")) / (F.col("centre2") - F.col("centre"))
    line = lambda a: F.when(F.col("centre2").isNull(), F.col(f"{a}")).otherwise(F.col(f"{a}") + share * (F.col(f"{a}2") - F.col(f"{a}")))
    return out.withColumns({"_m": line("mean"), "_s": F.greatest(line("sd"), F.lit(1e-9))}).drop("_x", "lo", "hi", "centre", "centre2", "mean", "mean2", "sd", "sd2").withColumnsRenamed({"_m": mean, "_s": sd})
