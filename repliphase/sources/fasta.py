"""GC content of windows along a FASTA file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repliphase.functions import genome


def gc_windows(spark: SparkSession, path: str, width: int = 200_000, autosomes_only: bool = True) -> DataFrame:
    """Rows (chrom, s, e, value): the share of G and C among all bases of each window.

    Lines are placed within the piece of their file that one task reads; a table with a row per
    piece says how many bases and which header come before it. Each line is cut at window borders and
    counted by itself, so neither a file nor a chromosome is ever one task.
    """
    # The upper bits of the number are the piece; a file's pieces are numbered in its order.
    number = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), number.alias("k"), F.input_file_name().alias("file"))
    lines = lines.withColumn("piece", F.shiftright("k", 33)).withColumn("head", F.when(F.startswith("line", F.lit(">")), F.regexp_extract("line", r"^>(\S+)", 1)))
    lines = lines.withColumn("n", F.when(F.col("head").isNull(), F.length("line")).otherwise(0))
    own = Window.partitionBy("file", "piece").orderBy("k")
    lines = lines.withColumn("inside", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    lines = lines.withColumn("mine", F.last(F.when(F.col("head").isNotNull(), F.struct("head", "inside")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = lines.groupBy("file", "piece").agg(F.sum("n").alias("bases"), F.max_by("mine", F.when(F.col("mine").isNotNull(), F.col("k"))).alias("last"))
    along = Window.partitionBy("file").orderBy("piece")  # a row per piece
    pieces = pieces.withColumn("before", F.sum("bases").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bases"))
    ended = F.when(F.col("last").isNotNull(), F.struct(F.col("last.head").alias("head"), (F.col("before") + F.col("last.inside")).alias("at")))
    pieces = pieces.withColumn("open", F.last(ended, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    rows = lines.where("n > 0").join(pieces.select("file", "piece", "before", "open"), ["file", "piece"])
    chrom = F.coalesce("mine.head", "open.head")
    begin = F.coalesce(F.col("before") + F.col("mine.inside"), F.col("open.at"))
    rows = rows.select(chrom.alias("chrom"), "line", F.col("n").cast("long").alias("n"), (F.col("before") + F.col("inside") - begin).alias("start")).where("chrom is not null")
    rows = rows.withColumn("w", F.explode(F.expr(f"sequence(start div {width}, (start + n - 1) div {width})")))
    part = F.expr(f"substring(line, cast(greatest(0, w * {width} - start) as int) + 1, cast(least(start + n, (w + 1) * {width}) - greatest(start, w * {width}) as int))")
    counted = rows.select("chrom", "w", F.length(part).alias("n"), F.length(F.regexp_replace(part, "[^GCgc]", "")).alias("gc"))
    out = counted.groupBy("chrom", "w").agg(F.sum("n").alias("n"), F.sum("gc").alias("gc"))
    out = out.select("chrom", (F.col("w") * width).alias("s"), (F.col("w") * width + F.col("n")).alias("e"), (F.col("gc") / F.col("n")).alias("value"))
    return out.where(genome.is_autosome(F.col("chrom")) & F.col("chrom").startswith("chr")) if autosomes_only else out
