"""Command line: ``run``, ``order``, ``bam2tag``, ``valid-bam`` and ``gc``.

``run`` and ``order`` take every field of Config as an option, with dashes.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import functions as F

from repliphase.config import Config
from repliphase.session import get_session


def parse_bool(value: str) -> bool:
    text = value.strip().lower()
    if text in ("1", "true", "yes", "y", "on"):
        return True
    if text in ("0", "false", "no", "n", "off"):
        return False
    raise argparse.ArgumentTypeError(f"{value!r} is neither true nor false")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="repliphase", description=__doc__)
    sub = top.add_subparsers(dest="command")
    order = sub.add_parser("order", help="order cells and infer the timing track")
    for name in ("fragments", "chrom-sizes", "anchor-bedgraph", "outdir"):
        order.add_argument(f"--{name}", required=True)
    run = sub.add_parser("run", help="from an alignment and a genome to the order: fragments, GC anchor and order in one")
    for name in ("bam", "fasta", "chrom-sizes", "outdir"):
        run.add_argument(f"--{name}", required=True)
    run.add_argument("--barcode-tag", default="CB")
    run.add_argument("--min-mapq", type=int, default=0)
    run.add_argument("--window", type=int, default=200_000)
    for command in (order, run):
        command.add_argument("--blacklist")
        for f in dataclasses.fields(Config):
            kind = {"bool": parse_bool, "int": int, "float": float}.get(str(f.type), str)
            command.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=f.default)
    tag = sub.add_parser("bam2tag", help="fragments and barcode counts of an alignment")
    tag.add_argument("-b", "--bam", required=True, help="a BAM or, by suffix, a SAM file")
    tag.add_argument("-p", "--prefix", required=True)
    tag.add_argument("-t", "--barcode-tag", default="CB")
    tag.add_argument("-q", "--min-mapq", type=int, default=0)
    tag.add_argument("--no-header", action="store_true")
    valid = sub.add_parser("valid-bam", help="the records of listed barcodes")
    valid.add_argument("-i", "--input", required=True)
    valid.add_argument("-o", "--out-prefix", required=True)
    valid.add_argument("-b", "--barcodes", default="NEG.txt")
    valid.add_argument("-s", "--suffix", default=".CB1K.bam", help="of the folder of BAM files that is written")
    valid.add_argument("-t", "--tag", default="CB")
    valid.add_argument("--index", action="store_true", help="also write an index table of the result")
    gc = sub.add_parser("gc", help="GC content of windows as a bedGraph")
    gc.add_argument("--fasta", required=True)
    gc.add_argument("--output", required=True)
    gc.add_argument("--window", type=int, default=200_000)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    spark = get_session()
    try:
        globals()[f"_{args.command.replace('-', '_')}"](spark, args)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


def _order(spark, args) -> None:
    from repliphase.sources import text_tables

    _analyse(spark, args, lambda: text_tables.read_fragments(spark, args.fragments), lambda chroms: text_tables.read_bedgraph(spark, args.anchor_bedgraph, chroms))


def _run(spark, args) -> None:
    from repliphase.functions.storage import settled
    from repliphase.sources import fasta, text_tables

    def anchor(chroms):
        return text_tables.on_chroms(fasta.gc_windows(spark, args.fasta, args.window), chroms).select("h", "s", "e", "value")

    _analyse(spark, args, lambda: settled(_fragments(spark, args)), anchor)


def _analyse(spark, args, fragments, anchor) -> None:
    from repliphase.plans import ordering
    from repliphase.sources import text_tables

    config = Config(**{f.name: getattr(args, f.name) for f in dataclasses.fields(Config)})
    chroms = text_tables.read_chrom_sizes(spark, args.chrom_sizes, config.chroms)
    blacklist = text_tables.read_intervals(spark, args.blacklist, chroms) if args.blacklist else None
    result = ordering.Ordering(fragments(), chroms, anchor(chroms), blacklist, config).run()
    ordering.write(result, args.outdir, config.sample)


def _fragments(spark, args):
    """Fragments of the records of an alignment that have the tag."""
    from repliphase.sources import bam, text_tables

    if args.bam.endswith((".sam", ".sam.gz")):
        rows = text_tables.read_sam(spark, args.bam)
    else:
        rows = bam.read(spark, args.bam, columns=["chrom", "pos", "mapq", "cigar", "tags"])
        rows = rows.withColumn("seq", F.monotonically_increasing_id()).where("size(tags) > 0")
    return text_tables.sam_fragments(rows, args.barcode_tag, args.min_mapq)


def _bam2tag(spark, args) -> None:
    from repliphase.sources import sinks, text_tables

    found = _fragments(spark, args)
    table = found.select(F.col("chrom").alias("chr"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("barcode").alias(args.barcode_tag), F.lit(1).alias("count"))
    sinks.write_table(table, f"{args.prefix}.fragments.txt", header=not args.no_header)
    counts = text_tables.barcode_counts(found).select(F.col("barcode").alias(args.barcode_tag), F.col("n").alias("count"))
    sinks.write_ordered(counts, f"{args.prefix}.{args.barcode_tag}_counts.txt", [-F.col("count"), args.barcode_tag])


def _valid_bam(spark, args) -> None:
    from repliphase.sources import bam, text_tables

    wanted = text_tables.read_barcodes(spark, args.barcodes)
    if not wanted.take(1):
        raise ValueError(f"{args.barcodes} lists no barcodes")
    target = args.out_prefix + args.suffix
    kept = bam.filter_bam(spark, args.input, target, wanted, args.tag, mode="overwrite")
    if args.index:
        bam.index(spark, target).write.mode("overwrite").parquet(f"{target}.index")
    print(f"{kept.count()} records kept")


def _gc(spark, args) -> None:
    from repliphase.sources import fasta, sinks

    sinks.write_bedgraph(fasta.gc_windows(spark, args.fasta, args.window), args.output, "GC")


if __name__ == "__main__":
    sys.exit(main())
