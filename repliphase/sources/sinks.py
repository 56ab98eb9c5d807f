"""Outputs: tab-separated tables, bedGraph, lists by bin and a JSON summary.

All go through Spark's writers, to any path that Spark can write, a folder of part files each. What
has an order is dealt over range partitions: the parts, one after the other by name, are the file,
with its head in the first of them. Missing values are ``NA``, floats have six significant digits.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _printable(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            # %g drops nothing but digits beyond the sixth; trailing zeros go by hand, as Java keeps them.
            text = F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+(e|$)", "$1$2")
            c = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.regexp_replace(text, r"\.(e|$)", "$1"))
        elif kind == "boolean":
            c = c.cast("int")
        out.append(c.alias(name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """A table without an order; each part has the header."""
    _printable(df).write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="NA", emptyValue="")


def _write_in_order(df: DataFrame, path: str, order: list[str | Column], head: list[str]) -> None:
    """The rows as tab-separated lines in ``order`` (nulls first), below the lines of ``head``; no task sees them all.

    Every row carries its place: lines of the head have one of their own each, all rows share the last one.
    """
    keys = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    value = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in df.columns))
    # Keys are taken from the values themselves, lines from what they are printed as.
    keyed = df.select("*", F.lit(len(head)).alias("__place"), F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys))).alias("__key"))
    lines = _printable(keyed).select("__place", "__key", value.alias("value"))
    if head:
        above = df.sparkSession.createDataFrame(list(enumerate(head)), "__place int, value string")
        lines = lines.unionByName(above, allowMissingColumns=True)
    lines.orderBy("__place", "__key").select("value").write.mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, order: list[str | Column], comments: list[str] = (), header: bool = True) -> None:
    """A table in the order of columns, below comment lines and one line of column names."""
    _write_in_order(df, path, order, [*(f"# {line}" for line in comments), *(["\t".join(df.columns)] if header else [])])


def write_bins(cells: DataFrame, path: str, barcode: str = "barcode", bin_col: str = "pseudotime_bin") -> None:
    """One folder per bin with its barcodes in order."""
    rows = cells.repartition(bin_col).sortWithinPartitions(bin_col, "global_order")
    rows.select(barcode, bin_col).write.mode("overwrite").partitionBy(bin_col).text(path)


def write_bedgraph(track: DataFrame, path: str, name: str) -> None:
    """A track in the order of its intervals, which ``text_tables.read_bedgraph`` reads again."""
    _write_in_order(track, path, ["chrom", "s"], [f'track type=bedGraph name="{name}"'])


def plain(value):
    """The value with non-finite numbers as None, for JSON."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.item() if hasattr(value, "item") else value


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """One JSON object; its size does not follow the data."""
    text = json.dumps(plain(summary), indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
