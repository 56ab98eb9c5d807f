"""Chromosome names, selections and bin grids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHROM_SIZE = 1_000_000


def chrom_core(name: Column) -> Column:
    """The name without a leading ``chr`` in any case."""
    return F.regexp_replace(name, "(?i)^chr", "")


def is_autosome(name: Column) -> Column:
    return F.rlike(chrom_core(name), F.lit("^[0-9]+$"))


def sort_class(name: Column) -> Column:
    """Numbers first, then X, Y and all others; the second sort key is ``sort_number``."""
    core = F.upper(chrom_core(name))
    return F.when(is_autosome(name), 0).when(core == "X", 1).when(core == "Y", 2).otherwise(3)


def sort_number(name: Column) -> Column:
    return F.when(is_autosome(name), chrom_core(name).try_cast("long")).otherwise(F.lit(0).cast("long"))


def natural_order(chroms: DataFrame, name: str = "name") -> list[Column]:
    return [sort_class(F.col(name)), sort_number(F.col(name)), F.col(name)]


def aliases(chroms: DataFrame) -> DataFrame:
    """Rows (alias, h): each name with and without ``chr``; a chromosome's exact name wins over an alias."""
    exact = chroms.select(F.col("name").alias("alias"), "h", F.lit(0).alias("_rank"))
    bare = chroms.select(chrom_core(F.col("name")).alias("alias"), "h", F.lit(1).alias("_rank"))
    full = chroms.select(F.concat(F.lit("chr"), chrom_core(F.col("name"))).alias("alias"), "h", F.lit(1).alias("_rank"))
    every = exact.union(bare).union(full)
    return every.groupBy("alias").agg(F.min(F.struct("_rank", "h")).alias("_m")).select("alias", F.col("_m.h").alias("h"))


def expand_spec(spec: str, names: list[str]) -> list[str]:
    """The names that a specification selects: ``auto`` or ``autosomes``, either with ``+x`` (or ``auto_x``), or a list with ranges such as ``chr1-chr5``.

    Entries may leave ``chr`` out; an unknown entry is an error.
    """
    def core(name: str) -> str:
        return re.sub("(?i)^chr", "", name)

    numbered = [n for n in names if core(n).isdigit()]
    token = spec.strip().lower()
    if token in ("auto", "autosomes"):
        return numbered
    if token in ("auto+x", "autosomes+x", "auto_x"):
        return numbered + [n for n in names if core(n).upper() == "X"]
    by_alias: dict[str, str] = {}
    for name in names:
        by_alias[name] = name
    for name in names:
        by_alias.setdefault(core(name), name)
        by_alias.setdefault("chr" + core(name), name)
    chosen: list[str] = []
    for part in filter(None, (x.strip() for x in spec.split(","))):
        span = re.fullmatch(r"(?i)(?:chr)?(\d+)-(?:chr)?(\d+)", part)
        wanted = [str(k) for k in range(int(span[1]), int(span[2]) + 1)] if span else [part]
        for item in wanted:
            if item not in by_alias:
                raise ValueError(f"unknown chromosome {item!r}")
            if by_alias[item] not in chosen:
                chosen.append(by_alias[item])
    return chosen


def with_bin_counts(chroms: DataFrame, width: int) -> DataFrame:
    """``chroms`` (h, name, size) with its number of bins and the number of bins before it."""
    counted = chroms.withColumn("nbin", F.expr(f"greatest(1L, (cast(size as long) + {width} - 1) div {width})"))
    before = counted.alias("a").join(counted.alias("b"), F.expr("b.h < a.h"), "left")  # some dozens of chromosomes
    offset = before.groupBy("a.h").agg(F.coalesce(F.sum("b.nbin"), F.lit(0)).cast("long").alias("offset"))
    return counted.join(offset, "h")


def grid(chroms: DataFrame, width: int) -> DataFrame:
    """Rows (h, bin, gbin, start, stop): all bins of all chromosomes; the last bin ends with its chromosome."""
    rows = with_bin_counts(chroms, width).select("h", "offset", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nbin") - 1)).alias("bin"))
    return rows.select("h", "bin", (F.col("offset") + F.col("bin")).alias("gbin"), (F.col("bin") * width).alias("start"), F.least((F.col("bin") + 1) * width, F.col("size")).alias("stop"))


def binned(events: DataFrame, chroms: DataFrame, width: int) -> DataFrame:
    """``events`` (h, p) with ``bin`` in their chromosome; positions outside are clamped to its first or last bin."""
    sizes = chroms.select("h", F.expr(f"greatest(1L, (cast(size as long) + {width} - 1) div {width})").alias("_n"))
    return events.join(sizes, "h").withColumn("bin", F.expr(f"least(greatest(p div {width}, 0L), _n - 1)")).drop("_n")
