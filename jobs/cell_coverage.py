"""Coverage of cells, kept up as event files arrive.

    python -m jobs.cell_coverage --tables DIR --out DIR --checkpoint DIR [--config FILE]

Reads ``events.parquet`` of the tables, a folder that files are added to, as a file stream with a
checkpoint; a run takes all files that no earlier run took, then stops. Written below ``out``:

* ``mask``: the merged intervals to leave out, made by the first run from ``supplier.parquet`` and kept,
  so that all events meet the same mask;
* ``parts/batch=N/h=H``: for each cell and bin the events kept and blocked among those of batch N;
* ``cells/status=S``: each cell's depth, breadth and quality status over all batches.

A batch that was cut off is run again with the same files and replaces its own partitions, so an event
counts once. A run without new files leaves everything as it was. Rows without an event id, cell or
time are rejected and counted in the log; a file delivered twice, under two names, counts twice.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, start, tally
from repliphase.functions import genome
from repliphase.functions.storage import settled
from repliphase.operators import events as ev_ops
from repliphase.operators import gates, intervals
from repliphase.plans import standin

LOG = logging.getLogger("jobs.cell_coverage")
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
USABLE = "event_id is not null and user_id is not null and ts is not null"
PARTS = "cell long, bin long, n long, blocked long, batch long, h int"


def _mask(spark: SparkSession, tables: str, out: str) -> DataFrame:
    """The intervals of the first run, which also makes the table of parts, without rows."""
    try:
        return spark.read.parquet(f"{out}/mask")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    spark.createDataFrame([], PARTS).write.mode("append").partitionBy("batch", "h").parquet(f"{out}/parts")
    standin.Tables(spark, tables).merged().write.mode("overwrite").parquet(f"{out}/mask")
    LOG.info("wrote the mask to %s/mask", out)
    return spark.read.parquet(f"{out}/mask")


def _batch(rows: DataFrame, number: int, mask: DataFrame, chroms: DataFrame, width: int, path: str) -> None:
    """Writes the counts of one batch over what an earlier try of it may have left."""
    read, rejected = tally(rows, f"not ({USABLE})")
    events = standin.as_events(rows.where(USABLE))
    flagged = genome.binned(intervals.flag_hits(events, mask), chroms, width)
    counts = flagged.groupBy("cell", "h", "bin").agg(F.count_if(~F.col("hit")).alias("n"), F.count_if("hit").alias("blocked"))
    counts = counts.withColumn("batch", F.lit(number).cast("long"))
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "h").parquet(path)
    wrote, _ = tally(rows.sparkSession.read.schema(PARTS).parquet(path).where(F.col("batch") == number))
    LOG.info("batch %d: read %d events, rejected %d, wrote %d counts", number, read, rejected, wrote)


def coverage(spark: SparkSession, out: str) -> DataFrame:
    """Rows (cell, h, bin, n, blocked) over all batches."""
    parts = spark.read.schema(PARTS).parquet(f"{out}/parts")
    return parts.groupBy("cell", "h", "bin").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))


def _cells(cover: DataFrame, mask: DataFrame, chroms: DataFrame, config: dict) -> DataFrame:
    """Rows (cell, n, blocked, n_bins, breadth, status)."""
    pooled = cover.groupBy("h", "bin").agg(F.sum(F.col("n") + F.col("blocked")).alias("n"))
    closed = intervals.bin_fraction(chroms, mask, config["width"]).where(F.col("fraction") > config["least_blocked"])
    usable = settled(ev_ops.usable_of(pooled, closed, None, config["coverage_low"], config["coverage_high"]))
    broad = ev_ops.breadth_of(cover.where("n > 0").withColumnRenamed("n", "c").join(usable.select("h", "bin"), ["h", "bin"]), usable)
    cells = cover.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).join(broad, "cell", "left")
    cells = cells.withColumns({
        "log_depth": F.log10(F.greatest("n", F.lit(1)).cast("double")), "breadth": F.coalesce("breadth", F.lit(0.0)),
        "n_bins": F.coalesce("n_bins", F.lit(0)), "n_signal": F.coalesce("n_events", F.lit(0)),
    })
    cells = settled(cells.withColumn("frac_signal", F.try_divide("n_signal", "n")))
    judged = gates.status(cells.where("n > 0"), gates.Gates(**config["gates"]))
    none = cells.where("n = 0").withColumn("status", F.lit("NO_FRAGMENTS"))
    names = ("cell", "n", "blocked", "n_bins", "breadth", "status")
    return judged.select(*names).union(none.select(*names))


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new and returns the cells as written."""
    config = config or load_config("cell_coverage")
    chroms = standin.Tables(spark, tables).chroms()
    mask = settled(_mask(spark, tables, out))
    source = f"{tables}/events.parque[t]"  # as a pattern, so that a table of one file streams like a folder
    LOG.info("reading new files of %s/events.parquet", tables)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda rows, number: _batch(rows, number, mask, chroms, config["width"], f"{out}/parts"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    cover = settled(coverage(spark, out))
    cells = _cells(cover, mask, chroms, config)
    cells.write.mode("overwrite").partitionBy("status").parquet(f"{out}/cells")
    written = spark.read.schema(cells.schema).parquet(f"{out}/cells")
    LOG.info("wrote %d cells to %s/cells", tally(written)[0], out)
    return written


def main() -> None:
    from repliphase.session import get_session

    args = start(__doc__, "tables", "out", "checkpoint")
    spark = get_session("cell_coverage")
    try:
        run(spark, args.tables, args.out, args.checkpoint, load_config("cell_coverage", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
