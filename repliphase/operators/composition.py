"""Composition of sequences that are texts in a table: a track of windows, and the mask of odd ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.operators import intervals


def windows(sequences: DataFrame, keys: list[str], text: str, width: int, letters: str, known: str = "A-Za-z") -> DataFrame:
    """Rows (keys..., s, e, known, hits) for each ``width`` characters of a sequence, the last window shorter.

    ``known`` counts the characters of that class, ``hits`` those of ``letters`` among them. A text
    is cut in one pass, whatever its length, and no text is shuffled. Sequences of equal keys are
    pooled window by window; a null or empty text has no windows.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    rows = sequences.select(*keys, F.posexplode(pieces).alias("w", "piece"))
    s = F.col("w").cast("long") * width
    rows = rows.select(
        *keys,
        s.alias("s"),
        (s + F.char_length("piece")).alias("e"),
        F.regexp_count("piece", F.lit(f"[{known}]")).alias("known"),
        F.regexp_count("piece", F.lit(f"[{letters}]")).alias("hits"),
    )
    return rows.groupBy(*keys, "s").agg(F.max("e").alias("e"), F.sum("known").alias("known"), F.sum("hits").alias("hits"))


def track(counted: DataFrame) -> DataFrame:
    """``windows`` with ``value``, the share of hits among known characters; NULL without any."""
    return counted.withColumn("value", F.try_divide("hits", "known")).drop("hits")


def odd(rows: DataFrame, least_known: float, low: float, high: float) -> DataFrame:
    """``track`` with ``odd``: too few known characters for the window's length, or a value beyond the limits."""
    few = F.col("known") < least_known * (F.col("e") - F.col("s"))
    return rows.withColumn("odd", few | F.coalesce((F.col("value") < low) | (F.col("value") > high), F.lit(True)))


def mask(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals (keys..., s, e) of touching odd windows."""
    spans = rows.where("odd").select(F.struct(*keys).alias("h"), "s", "e")
    return intervals.merge(spans).select(*[F.col(f"h.{k}").alias(k) for k in keys], "s", "e")
