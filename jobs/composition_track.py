"""Composition track and mask of sequences that are texts in a table.

    python -m jobs.composition_track --tables DIR --out DIR [--config FILE]

Reads ``documents.parquet`` of the tables, a sequence per document, and counts in windows of fixed width
the share of some letters among the known ones, as one does with G and C for an anchor track. Windows
with too few known letters, or a share beyond limits, are odd; touching ones become intervals of a mask.
Written below ``out``, a folder for each source:

* ``track/source_key=K``: (doc_id, source, s, e, known, value, odd) of every window;
* ``mask/source_key=K``: (doc_id, source, s, e), disjoint.

K is ``=`` and the source, or ``none`` where it is null, so that a null and an empty source stay apart. A
run replaces both tables as a whole, so a rerun gives the same. Sequences of one source and id are pooled
window by window; rows without an id are rejected and counted in the log; empty texts have no windows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, start, tally
from repliphase.operators import composition

LOG = logging.getLogger("jobs.composition_track")
KEYS = ["source", "doc_id"]


def _written(rows: DataFrame, path: str) -> DataFrame:
    """The rows below a folder for each source; tasks share a large source and small ones share a task."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("none"))
    rows = rows.withColumn("source_key", key).hint("rebalance", "source_key")
    rows.write.mode("overwrite").partitionBy("source_key").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    LOG.info("wrote %d rows to %s", tally(written)[0], path)
    return written


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes both tables and returns them (track, mask) as written."""
    config = config or load_config("composition_track")
    docs = spark.read.parquet(f"{tables}/documents.parquet").select(*KEYS, "text")
    read, rejected = tally(docs, "doc_id is null")
    LOG.info("read %d documents of %s, rejected %d", read, tables, rejected)
    found = composition.windows(docs.where("doc_id is not null"), KEYS, "text", config["width"], config["letters"], config["known"])
    rows = composition.odd(composition.track(found), config["least_known"], config["low"], config["high"])
    track = _written(rows.select("doc_id", "source", "s", "e", "known", "value", "odd"), f"{out}/track")
    mask = _written(composition.mask(track, KEYS).select("doc_id", "source", "s", "e"), f"{out}/mask")
    return track.drop("source_key"), mask.drop("source_key")


def main() -> None:
    from repliphase.session import get_session

    args = start(__doc__, "tables", "out")
    spark = get_session("composition_track")
    try:
        run(spark, args.tables, args.out, load_config("composition_track", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
