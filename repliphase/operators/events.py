"""Events (seq, cell, h, p): gaps, the collapse of near duplicates, depth and coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions import genome, stats

# Fixed values of the collapse distance: the gaps that part short from long ones and end the
# long ones, the least number of gaps and share of short ones, and the bounds of the result.
SHORT_GAP, LONG_GAP, LEAST_GAPS, LEAST_SHORT, LEAST_DISTANCE, FALLBACK = 300, 5000, 1000, 0.03, 50, 200

def adjacent_gaps(events: DataFrame) -> DataFrame:
    """``events`` with ``gap``: the distance from the event before in the cell and chromosome; zero and first gaps are NULL."""
    by = Window.partitionBy("cell", "h").orderBy("p", "seq")
    return events.withColumn("gap", F.nullif(F.col("p") - F.lag("p").over(by), F.lit(0).cast("long")))


def pooled_gaps(events: DataFrame, max_gap: int = 1_000_000, sample_cells: int | None = None, seed: int = 1) -> DataFrame:
    """The gaps below ``max_gap`` as one column, of the ``sample_cells`` cells with the smallest hashes if given."""
    if sample_cells:
        cells = events.select("cell").distinct().orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(sample_cells)
        events = events.join(cells, "cell", "left_semi")
    return adjacent_gaps(events).where(f"gap is not null and gap < {max_gap}").select("gap")


def collapse_distance(gaps: DataFrame, maximum: int = 500) -> tuple[int, dict]:
    """The distance below which events of a cell count as one, from the dip between short and long gaps.

    0 with fewer than 1000 gaps or fewer than 3 % below 300; ``min(200, maximum)`` if there is no dip.
    """
    n, short = gaps.agg(F.count("*"), F.avg((F.col("gap") < SHORT_GAP).cast("double"))).first()
    if n < LEAST_GAPS:
        return 0, {"mode": "too_few_gaps"}
    if short < LEAST_SHORT:
        return 0, {"mode": "no_short_gap_peak", "short_fraction": short}
    smooth = antimode_table(gaps).collect()  # 240 rows
    parting, end = math.log10(SHORT_GAP), math.log10(LONG_GAP)
    before = [r for r in smooth if r.centre < parting]
    after = [r for r in smooth if parting < r.centre < end]
    first = max(before, key=lambda r: (r.smooth, -r.bin))
    second = max(after, key=lambda r: (r.smooth, -r.bin))
    between = [r for r in smooth if first.bin < r.bin < second.bin]
    if not between:
        return min(FALLBACK, maximum), {"mode": "fallback", "short_fraction": short}
    dip = min(between, key=lambda r: (r.smooth, r.bin)).centre
    return int(min(max(10**dip, LEAST_DISTANCE), maximum)), {"mode": "antimode", "short_fraction": short, "antimode_bp": 10**dip}


def antimode_table(gaps: DataFrame) -> DataFrame:
    """Rows (bin, centre, smooth): the smoothed histogram of log10 gaps."""
    smooth = stats.gaussian_smooth(stats.log10_histogram(gaps, "gap"), 2.0)
    return smooth.select("bin", ((F.col("bin") + 0.5) * 0.025).alias("centre"), F.round("smooth", 9).alias("smooth"))


def collapse(events: DataFrame, chroms: DataFrame, distance: int) -> DataFrame:
    """One event, the earliest by seq, for each cell and stretch of ``distance``; all events if it is 1 or less."""
    if distance <= 1:
        return events
    by = Window.partitionBy("cell", "h", "bin").orderBy("seq")
    return genome.binned(events, chroms, distance).withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r", "bin")


def depth(events: DataFrame) -> DataFrame:
    """Rows (cell, n, log_depth)."""
    return events.groupBy("cell").agg(F.count("*").alias("n")).withColumn("log_depth", F.log10(F.greatest("n", F.lit(1)).cast("double")))


def usable_bins(raw: DataFrame, chroms: DataFrame, width: int, blocked: DataFrame, anchor: DataFrame | None = None, low: float = 0.01, high: float = 0.999) -> DataFrame:
    """Rows (h, bin, n): bins neither blocked nor without anchor or events, of a coverage within these quantiles."""
    pooled = genome.binned(raw, chroms, width).groupBy("h", "bin").agg(F.count("*").alias("n"))
    return usable_of(pooled, blocked, anchor, low, high)


def usable_of(pooled: DataFrame, blocked: DataFrame, anchor: DataFrame | None = None, low: float = 0.01, high: float = 0.999) -> DataFrame:
    """The same from the events of each bin (h, bin, n)."""
    found = pooled.join(blocked.where("fraction > 0.5"), ["h", "bin"], "left_anti")
    if anchor is not None:
        found = found.join(anchor, ["h", "bin"], "left_semi")
    limits = stats.quantiles(found, "n", [low, high], few=True)  # a row per bin of the genome
    return found.crossJoin(limits).where("n >= q0 - 1e-9D and n <= q1 + 1e-9D").select("h", "bin", "n")  # limits: one row


def breadth(events: DataFrame, chroms: DataFrame, width: int, usable: DataFrame, alias: str = "breadth") -> DataFrame:
    """Rows (cell, n_events, n_bins, breadth): events in usable bins, and the share of usable bins with any."""
    rows = genome.binned(events, chroms, width).join(usable.select("h", "bin"), ["h", "bin"])
    # Two steps keep a cell of very many events from being one task.
    return breadth_of(rows.groupBy("cell", "h", "bin").agg(F.count("*").alias("c")), usable, alias)


def breadth_of(bins: DataFrame, usable: DataFrame, alias: str = "breadth") -> DataFrame:
    """The same from the events of each cell in each usable bin that has any (cell, h, bin, c)."""
    total = usable.agg(F.count("*").alias("_n"))
    out = bins.groupBy("cell").agg(F.sum("c").alias("n_events"), F.count("*").alias("n_bins"))
    return out.crossJoin(total).select("cell", "n_events", "n_bins", (F.col("n_bins") / F.col("_n")).alias(alias))  # total: one row


def cell_anchor(events: DataFrame, chroms: DataFrame, width: int, usable: DataFrame, anchor: DataFrame) -> DataFrame:
    """Rows (cell, cell_anchor): the mean anchor value of a cell's events in usable bins."""
    bins = genome.binned(events, chroms, width).groupBy("cell", "h", "bin").agg(F.count("*").alias("c"))
    rows = bins.join(usable.select("h", "bin"), ["h", "bin"]).join(anchor, ["h", "bin"])
    return rows.groupBy("cell").agg((F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("cell_anchor"))
