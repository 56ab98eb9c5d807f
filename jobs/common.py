"""What the jobs share: config files, counts for the log, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_config(name: str, path: str | None = None) -> dict:
    """The job's config file, or the one beside the job."""
    return json.loads(Path(path).read_text() if path else (Path(__file__).parent / f"{name}.json").read_text())


def tally(df: DataFrame, rejected: str = "false") -> tuple[int, int]:
    """The rows, and how many of them are rejected; of a file this reads the columns of the condition alone."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(rejected)).alias("rejected")).first()
    return row["rows"], row["rejected"]


def start(description: str, *paths: str) -> argparse.Namespace:
    """Command line of a job: its paths and an optional config file."""
    parser = argparse.ArgumentParser(description=description, formatter_class=argparse.RawDescriptionHelpFormatter)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file in place of the one beside the job")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
