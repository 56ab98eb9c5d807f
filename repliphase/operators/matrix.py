"""Cell by bin occupancy in long form: (cell, h, col), its dilation, shifts, blocks and information.

``col`` numbers the kept bins of the whole grid; neighbours are neighbouring kept columns, so a
removed bin between two kept ones does not part them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions import genome, ranks


def cell_bins(events: DataFrame, chroms: DataFrame, width: int) -> DataFrame:
    """Rows (cell, h, bin, n)."""
    return genome.binned(events, chroms, width).groupBy("cell", "h", "bin").agg(F.count("*").alias("n"))


def columns(chroms: DataFrame, width: int, blocked: DataFrame | None = None, autosomes_only: bool = False) -> DataFrame:
    """Rows (h, bin, col, first, last): the kept bins in order, with their chromosome's first and last column."""
    bins = genome.grid(chroms, width).select("h", "bin")
    if blocked is not None:
        bins = bins.join(blocked.where("fraction > 0.5"), ["h", "bin"], "left_anti")
    if autosomes_only:
        autosomes = chroms.where(genome.is_autosome(F.col("name"))).select("h")
        if autosomes.count() >= 4:
            bins = bins.join(autosomes, "h", "left_semi")
    bins = bins.withColumn("col", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", "bin")) - 1).cast("long"))  # one row per bin
    own = Window.partitionBy("h")
    return bins.withColumns({"first": F.min("col").over(own), "last": F.max("col").over(own)})


def occupancy(events: DataFrame, chroms: DataFrame, width: int, cols: DataFrame) -> DataFrame:
    """Rows (cell, h, col): which kept bins a cell occupies."""
    return cell_bins(events, chroms, width).join(cols.select("h", "bin", "col"), ["h", "bin"]).select("cell", "h", "col")


def dilate(occ: DataFrame, cols: DataFrame, radius: int) -> DataFrame:
    """Each occupied column spreads to ``radius`` columns on both sides, within its chromosome.

    Columns are taken in order and each gives only what lies beyond the reach of the one before, so nothing comes
    twice and no task holds a table of the spread rows.
    """
    if radius <= 0:
        return occ.select("cell", "h", "col").distinct()
    ends = cols.select("h", "first", "last").distinct()
    before = F.lag("col").over(Window.partitionBy("cell", "h").orderBy("col"))
    rows = occ.select("cell", "h", "col").withColumn("from", F.coalesce(before + (radius + 1), F.col("col") - radius)).join(ends, "h")
    rows = rows.selectExpr("cell", "h", f"greatest(first, col - {radius}, from) as a", f"least(last, col + {radius}) as b").where("a <= b")
    return rows.select("cell", "h", F.explode(F.sequence("a", "b")).alias("col"))


def circular_shift(occ: DataFrame, cols: DataFrame, replicate: int) -> DataFrame:
    """Each cell's columns of a chromosome, rotated by an offset that depends on cell, chromosome and replicate."""
    ends = cols.groupBy("h").agg(F.min("col").alias("f"), F.count("*").alias("len"))
    rows = occ.join(ends, "h")
    moved = F.pmod(F.col("col") - F.col("f") - (F.col("cell") * 7919 + F.col("h") * 104729 + replicate * 1299709), F.col("len"))
    return rows.select("cell", "h", (F.col("f") + moved).alias("col"))


def blocks(cols: DataFrame, target: int, budget: int, min_bins: int = 64) -> DataFrame:
    """Rows (col, block, n_bins): the block of each column and the block's size.

    A chromosome's columns are cut into parts of near-equal size. Of the part sizes on a geometric
    scale the smallest is taken with which there are at most ``budget`` parts, ``target`` being
    what the scale begins at. With more chromosomes than the budget they are packed whole.
    """
    budget = max(4, budget)
    sizes = cols.groupBy("h").agg(F.count("*").alias("n"))  # a row per chromosome, as all tables here but cols
    parts = _packed(sizes, budget) if sizes.count() > budget else _parts(sizes, target, budget, min_bins)
    place = F.expr("cast(before + ((col - first + 1) * parts - 1) div n as int)")
    rows = cols.join(parts, "h").select("col", place.alias("block"))
    return rows.join(rows.groupBy("block").agg(F.count("*").alias("n_bins")), "block").select("col", "block", "n_bins")


#: Part sizes that are tried, each a quarter larger than the one before.
_SCALE, _GROWTH = 64, 1.25


def _parts(sizes: DataFrame, target: int, budget: int, min_bins: int) -> DataFrame:
    """Rows (h, n, parts, before): how many parts each chromosome has, and those before it."""
    every = Window.partitionBy(F.lit(0))
    wanted = F.least(F.greatest(F.lit(target), F.count("*").over(every)), F.lit(budget))
    rows = sizes.withColumn("least", F.greatest(F.sum("n").over(every) / wanted, F.lit(float(min_bins))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(_SCALE - 1))))
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.rint(F.col("n") / (F.col("least") * F.pow(F.lit(_GROWTH), "step"))).cast("long")))
    rows = rows.withColumn("parts", F.least("parts", F.greatest(F.lit(1), F.expr(f"n div {min_bins}"))))
    rows = rows.withColumn("fits", F.sum("parts").over(Window.partitionBy("step")) <= budget)
    rows = rows.withColumn("chosen", F.min(F.when(F.col("fits"), F.col("step"))).over(every)).where("step = chosen")
    before = every.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("h", "n", "parts", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("before"))


def _packed(sizes: DataFrame, bins: int) -> DataFrame:
    """Rows (h, n, parts, before): each chromosome, largest first, as a whole in the block with the fewest columns."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "h"))), lambda x: F.struct(x.h.alias("h"), (-x.m).alias("n")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), bins).alias("loads"), F.array().cast("array<struct<h:int,n:long,b:long>>").alias("out"))

    def put(state, chrom):
        at = F.array_position(state.loads, F.array_min(state.loads))
        loads = F.transform(state.loads, lambda load, k: load + F.when(k + 1 == at, chrom.n).otherwise(0))
        return F.struct(loads.alias("loads"), F.concat(state.out, F.array(F.struct(chrom.h.cast("int").alias("h"), chrom.n.alias("n"), (at - 1).cast("long").alias("b")))).alias("out"))

    packed = sizes.agg(listed.alias("all")).select(F.explode(F.aggregate("all", start, put).out).alias("x"))
    return packed.select("x.h", "x.n", F.lit(1).cast("long").alias("parts"), F.col("x.b").alias("before"))


def block_counts(occ: DataFrame, block_of: DataFrame) -> DataFrame:
    """Rows (cell, block, n_bins, k): occupied columns of each block that a cell occupies at all."""
    return occ.join(block_of, "col").groupBy("cell", "block", "n_bins").agg(F.count("*").alias("k"))


def information(occ: DataFrame, block_of: DataFrame) -> DataFrame:
    """Rows (cell, valid_blocks, info_weight): blocks that are neither empty nor full, and their smaller counts summed."""
    m = block_counts(occ, block_of).withColumn("m", F.least("k", F.col("n_bins") - F.col("k")))
    return m.groupBy("cell").agg(F.count_if(F.col("m") > 0).alias("valid_blocks"), F.sum("m").alias("info_weight"))


def support(occ: DataFrame) -> DataFrame:
    return occ.groupBy("cell").agg(F.count("*").alias("support"))


def pick_landmarks(sizes: DataFrame, cap: int) -> DataFrame:
    """Rows (cell, support): all cells up to ``cap``, else about ``cap`` at even ranks of (support, cell), first and last among them."""
    n = sizes.count()
    if cap <= 0 or n <= cap:
        return sizes
    placed = ranks.numbered(sizes, ["support", "cell"], "r").withColumn("r", F.col("r") - 1)
    wanted = sizes.sparkSession.range(cap).select(F.rint(F.col("id") * ((n - 1) / max(cap - 1, 1))).cast("int").alias("r")).distinct()
    return placed.join(wanted, "r", "left_semi").drop("r")


def region_counts(events: DataFrame, h: int, start: int, end: int, width: int) -> DataFrame:
    """Rows (cell, bin, n, share): events of a half-open region by bin, and log1p(n) over the cell's largest."""
    rows = events.where(f"h = {h} and p >= {start} and p < {end}").withColumn("bin", F.expr(f"(p - {start}) div {width}"))
    rows = rows.groupBy("cell", "bin").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.log1p("n") / F.max(F.log1p("n")).over(Window.partitionBy("cell")))
