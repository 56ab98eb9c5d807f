"""Cutting lineage where all executors can read the rows again."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which driver and executors share.

    A temporary one is set only if none is named and driver and executors are one process.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles that nothing refers to any more, of which its cleaner learns when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
