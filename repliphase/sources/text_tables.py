"""Text tables: chromosome sizes, BED, bedGraph, fragments, SAM, barcode lists and region literals.

Scans go through Spark's text reader, so gzip and any file system that Spark reads work;
block-gzipped files (``.gz``, ``.bgz``) are read in pieces, a file by many tasks. Lines that cannot be
read are skipped; comments are lines that begin with ``#``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repliphase.functions import genome
from repliphase.operators import intervals
from repliphase.sources import bgzf

_TRACK = r"^(#|track|browser|\s*$)"
#: CIGAR operations that consume the reference.
REFERENCE_OPS = "MDN=X"


def _blocked(path: str) -> bool:
    return path.endswith((".gz", ".bgz")) and all(bgzf.is_bgzf(name) for name, _ in bgzf.files(path))


def raw_lines(spark: SparkSession, path: str, split: int = bgzf.SPLIT) -> DataFrame:
    """Rows (value), one per line."""
    return bgzf.read_lines(spark, path, split) if _blocked(path) else spark.read.text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return raw_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_chrom_sizes(spark: SparkSession, path: str, spec: str = "auto+x", minimum: int = genome.MIN_CHROM_SIZE) -> DataFrame:
    """Rows (h, name, size) of the selected chromosomes above ``minimum``, numbered in natural order; at least 4."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(~F.col("value").startswith("#")).select(F.get(parts, 0).alias("name"), F.get(parts, 1).try_cast("long").alias("size")).where("size is not null")
    found = [r.name for r in rows.orderBy(*genome.natural_order(rows)).select("name").collect()]  # one row per chromosome
    chosen = genome.expand_spec(spec, found)
    kept = rows.where(F.col("name").isin(chosen) & (F.col("size") > minimum)).orderBy(*genome.natural_order(rows)).collect()
    if len(kept) < 4:
        raise ValueError(f"{len(kept)} usable chromosomes; at least 4 are needed")
    return spark.createDataFrame([(k, r["name"], r["size"]) for k, r in enumerate(kept)], "h int, name string, size long")


def on_chroms(rows: DataFrame, chroms: DataFrame) -> DataFrame:
    """Rows with a known ``chrom``, as its number h."""
    return rows.join(genome.aliases(chroms), F.col("chrom") == F.col("alias")).drop("chrom", "alias")


def read_intervals(spark: SparkSession, path: str, chroms: DataFrame) -> DataFrame:
    """Merged intervals (h, s, e) of a BED file."""
    parts = F.split("value", r"\s+")
    rows = _lines(spark, path).where(~F.rlike(F.col("value"), F.lit(_TRACK))).select(F.get(parts, 0).alias("chrom"), F.get(parts, 1).try_cast("long").alias("s"), F.get(parts, 2).try_cast("long").alias("e"))
    return intervals.merge(on_chroms(rows.where("e > s"), chroms))


def read_bedgraph(spark: SparkSession, path: str, chroms: DataFrame) -> DataFrame:
    """Rows (h, s, e, value) of a bedGraph; values that are not finite are skipped."""
    parts = F.split("value", r"\s+")
    rows = _lines(spark, path).where(~F.rlike(F.col("value"), F.lit(_TRACK)) & (F.size(parts) >= 4))
    rows = rows.select(F.get(parts, 0).alias("chrom"), F.get(parts, 1).try_cast("long").alias("s"), F.get(parts, 2).try_cast("long").alias("e"), F.get(parts, 3).try_cast("double").alias("value"))
    return on_chroms(rows.where("e > s and not isnan(value) and abs(value) < double('infinity')"), chroms).select("h", "s", "e", "value")


def sniff_fragments(spark: SparkSession, path: str) -> tuple[int, bool]:
    """The number of columns of a fragment table, and whether its first line is a header."""
    columns, header = _sniffed(spark, path)
    return columns, header is not None


def _sniffed(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number of columns and the header, if there is one."""
    first = spark.read.text(path).where("not startswith(value, '#') and length(trim(value)) > 0").head()
    if first is None:
        raise ValueError(f"{path} has no rows")
    parts = first.value.rstrip("\r").split("\t")
    if len(parts) < 4:
        raise ValueError(f"{path} has {len(parts)} columns; at least 4 are needed")
    return len(parts), None if all(re.fullmatch(r"\s*[+-]?\d+\s*", x) for x in parts[1:3]) else first.value


def read_fragments(spark: SparkSession, path: str, split: int = bgzf.SPLIT) -> DataFrame:
    """Rows (seq, chrom, s, e, barcode) in file order; only the first four columns are parsed."""
    columns, header = _sniffed(spark, path)
    if _blocked(path):
        lines = bgzf.read_lines(spark, path, split).where("not startswith(value, '#') and length(value) > 0")
        if header is not None:
            lines = lines.where(F.col("value") != header)
        parts = F.split("value", "\t", 5)
        rows = lines.select(*[F.nullif(F.get(parts, k), F.lit("")).alias(c) for k, c in enumerate(("chrom", "s", "e", "barcode"))])
    else:
        schema = ", ".join(["chrom string", "s string", "e string", "barcode string", *[f"extra_{k} string" for k in range(columns - 4)]])
        rows = spark.read.schema(schema).csv(path, sep="\t", comment="#", header=header is not None, mode="PERMISSIVE")
    # Within a file ids rise with the line; they need no shuffle.
    return rows.select(F.monotonically_increasing_id().alias("seq"), "chrom", F.col("s").try_cast("long"), F.col("e").try_cast("long"), "barcode")


def valid_fragments(rows: DataFrame, chroms: DataFrame, min_length: int = 0, max_length: int = 0) -> DataFrame:
    """Rows (seq, h, s, e, barcode) on known chromosomes with e > s and a length within the limits (0: none).

    A fragment without a barcode is left out.
    """
    ok = rows.where("s is not null and e is not null and e > s and barcode is not null")
    if min_length > 0:
        ok = ok.where(F.col("e") - F.col("s") >= min_length)
    if max_length > 0:
        ok = ok.where(F.col("e") - F.col("s") <= max_length)
    return on_chroms(ok, chroms).select("seq", "h", "s", "e", "barcode")


def midpoints(fragments: DataFrame) -> DataFrame:
    """Fragments (s, e) as events at p, their middle rounded down."""
    return fragments.withColumn("p", F.expr("(s + e) div 2")).drop("s", "e")


def cigar_length(cigar: Column) -> Column:
    """The number of reference bases that a CIGAR string covers; ``*`` covers none."""
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{REFERENCE_OPS}]"), F.lit(1))
    return F.aggregate(F.transform(runs, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Rows (seq, chrom, pos, mapq, cigar, tags) of SAM alignments with at least one optional field."""
    parts = F.split("value", "\t")
    rows = raw_lines(spark, path).where("not startswith(value, '@')").withColumn("f", parts).where(F.size("f") >= 12)
    return rows.select(
        F.monotonically_increasing_id().alias("seq"), F.get("f", 2).alias("chrom"), F.get("f", 3).try_cast("long").alias("pos"),
        F.get("f", 4).try_cast("int").alias("mapq"), F.get("f", 5).alias("cigar"), F.slice("f", 12, 1 << 20).alias("tags"),
    )


def tag_value(tags: Column, tag: str) -> Column:
    """The string value of the first field of this tag; NULL if there is none or it is ``-``."""
    value = F.substring(F.get(F.filter(tags, lambda x: x.startswith(f"{tag}:Z:")), 0), len(tag) + 4, 1 << 20)
    return F.when(value != "-", value)


def sam_fragments(sam: DataFrame, tag: str = "CB", min_mapq: int = 0, zero_based: bool = False) -> DataFrame:
    """Rows (seq, chrom, s, e, barcode) of tagged, placed alignments.

    s and e are 1-based and inclusive; ``zero_based`` gives half-open ones instead.
    """
    rows = sam.withColumns({"len": cigar_length(F.col("cigar")), "barcode": tag_value(F.col("tags"), tag)})
    rows = rows.where(f"chrom <> '*' and pos <> 0 and cigar <> '*' and mapq >= {min_mapq} and len > 0 and barcode is not null")
    return rows.select("seq", "chrom", (F.col("pos") - (1 if zero_based else 0)).alias("s"), (F.col("pos") + F.col("len") - 1).alias("e"), "barcode")


def barcode_counts(fragments: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Rows (barcode, n), most frequent first, ties by barcode."""
    return fragments.groupBy(barcode).agg(F.count("*").alias("n")).orderBy(F.desc("n"), barcode)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """The distinct barcodes of a list."""
    return _lines(spark, path).select(F.trim("value").alias("barcode")).where("barcode <> '' and not startswith(barcode, '#')").distinct()


def keep_barcodes(rows: DataFrame, barcodes: DataFrame, column: str = "barcode") -> DataFrame:
    return rows.join(barcodes.select(F.col(barcodes.columns[0]).alias(column)), column, "left_semi")


def parse_region(text: str | None, chroms: DataFrame) -> tuple[int, int, int] | None:
    """(h, start, end) of a region such as ``chr10:80,000,000-110,000,000``; None if it cannot be read."""
    match = re.fullmatch(r"\s*([^:\s]+):([\d,]+)-([\d,]+)\s*", text or "")
    if not match:
        return None
    start, end = (int(match[k].replace(",", "")) for k in (2, 3))
    row = genome.aliases(chroms).where(F.col("alias") == match[1]).head()
    return (row.h, start, end) if row is not None and end > start else None
