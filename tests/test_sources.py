"""Files in and out: text tables, SAM and BAM, FASTA, command line and streams."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from repliphase import cli
from repliphase.operators import intervals
from repliphase.sources import bam, fasta, sinks
from repliphase.sources import text_tables as tt
from repliphase.streaming import ingest


@pytest.fixture(scope="module")
def chroms(spark):
    return spark.createDataFrame([(0, "chr1", 5_000_000), (1, "chr2", 4_000_000)], "h int, name string, size long")


def joined(folder):
    """The lines of a folder's parts, one after the other by name."""
    return [x for p in sorted(folder.glob("part*")) for x in p.read_text().splitlines()]


def test_chrom_sizes(spark, tmp_path):
    path = tmp_path / "sizes"
    path.write_text("chr2 2000000\nchr10\t3000000\nchrX 1500000\nchr1 4000000\nchrM 16000\nbad line\nchr3 9999999\n# x\n")
    found = tt.read_chrom_sizes(spark, str(path)).orderBy("h").collect()
    assert [(r.h, r.name) for r in found] == [(0, "chr1"), (1, "chr2"), (2, "chr3"), (3, "chr10"), (4, "chrX")]
    with pytest.raises(ValueError):
        tt.read_chrom_sizes(spark, str(path), "chr1-chr3")


def test_bed_and_bedgraph(spark, tmp_path, chroms):
    bed = tmp_path / "a.bed.gz"
    with gzip.open(bed, "wt") as out:
        out.write("track x\n#c\n\nchr1 0 10 High Signal\n1\t10\t20\nchr9 1 5\nchr2 7 7\nchr2 x 9\n")
    assert [tuple(r) for r in tt.read_intervals(spark, str(bed), chroms).collect()] == [(0, 0, 20)]
    graph = tmp_path / "a.bg"
    graph.write_text("browser y\nchr1\t0\t100\t0.5\n2 5 9 nan\n2 5 9 1e3\nchr1 4 5\n")
    assert sorted(map(tuple, tt.read_bedgraph(spark, str(graph), chroms).collect())) == [(0, 0, 100, 0.5), (1, 5, 9, 1000.0)]


def test_fragments(spark, tmp_path, chroms):
    path = tmp_path / "f.tsv"
    path.write_text("# c\nchr\tstart\tend\tCB\tcount\nchr1\t10\t20\tA\t1\n2\t5\t5\tB\t1\nchr7\t1\t9\tA\t1\nchr2\tx\t9\tA\t1\nchr2\t100\t201\tB\t1\nchr1\t1\t9\t\t1\n")
    assert tt.sniff_fragments(spark, str(path)) == (5, True)
    rows = tt.valid_fragments(tt.read_fragments(spark, str(path)), chroms, 2, 500)
    found = sorted((r.h, r.p, r.barcode) for r in tt.midpoints(rows).collect())
    assert found == [(0, 15, "A"), (1, 150, "B")]
    path.write_text("chr1\t1\t2\n")
    with pytest.raises(ValueError):
        tt.sniff_fragments(spark, str(path))


def test_cigars(spark):
    df = spark.createDataFrame([("10M2I3D4S",), ("5H3=2X1N",), ("*",), ("",)], "c string")
    assert [r[0] for r in df.select(tt.cigar_length(df.c)).collect()] == [13, 6, 0, 0]


SAM = ["@HD\tVN:1", "r1\t0\tchr1\t100\t30\t5M\t*\t0\t0\t*\t*\tNM:i:0\tCB:Z:AA", "r2\t0\tchr1\t100\t30\t5M\t*\t0\t0\t*\t*", "r3\t0\tchr1\t100\t3\t5M\t*\t0\t0\t*\t*\tCB:Z:AA", "r4\t0\tchr1\t100\t30\t5M\t*\t0\t0\t*\t*\tCB:Z:-", "r5\t0\tchr1\t100\t30\t5M\t*\t0\t0\t*\t*\tXX:Z:q", "r6\t4\t*\t0\t30\t*\t*\t0\t0\t*\t*\tCB:Z:AA", "r7\t0\tchr2\t7\t30\t1M\t*\t0\t0\t*\t*\tCB:Z:BB"]


def test_sam(spark, tmp_path, chroms):
    path = tmp_path / "a.sam"
    path.write_text("\n".join(SAM) + "\n")
    sam = tt.read_sam(spark, str(path))
    found = tt.sam_fragments(sam, min_mapq=10)
    assert sorted((r.chrom, r.s, r.e, r.barcode) for r in found.collect()) == [("chr1", 100, 104, "AA"), ("chr2", 7, 7, "BB")]
    # An alignment of one base has no length between its inclusive ends.
    assert [r.barcode for r in tt.valid_fragments(found, chroms).collect()] == ["AA"]
    assert sorted(r.barcode for r in tt.valid_fragments(tt.sam_fragments(sam, min_mapq=10, zero_based=True), chroms).collect()) == ["AA", "BB"]


def test_command_line(spark, bam_file, tmp_path, capsys):
    names = tmp_path / "names"
    names.write_text("# c\n AA \n\nBB\nAA\n")
    assert sorted(r.barcode for r in tt.read_barcodes(spark, str(names)).collect()) == ["AA", "BB"]
    assert cli.main(["valid-bam", "-i", str(bam_file), "-o", str(tmp_path / "c"), "-b", str(names), "--index"]) == 0
    assert "2000 records" in capsys.readouterr().out
    assert bam.read(spark, found=spark.read.parquet(str(tmp_path / "c.CB1K.bam.index"))).count() == 2000
    names.write_text("# nobody\n")
    assert cli.main(["valid-bam", "-i", str(bam_file), "-o", str(tmp_path / "d"), "-b", str(names), "-s", ".x"]) == 2
    assert cli.main(["bam2tag", "-b", str(bam_file), "-p", str(tmp_path / "p"), "-q", "10"]) == 0
    counts = [p.read_text() for p in (tmp_path / "p.CB_counts.txt").glob("part*")]
    assert counts == ["CB\tcount\nAA\t1000\nBB\t1000\n"]
    assert cli.main([]) == 0
    assert cli.main(["order", "--fragments", "x", "--chrom-sizes", "x", "--anchor-bedgraph", "x", "--outdir", "x", "--depth-lower-quantile", "0.9", "--depth-upper-quantile", "0.1"]) == 2
    assert cli.parse_bool("Yes") is True


def test_gc_windows(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">chr1 x\nACGT\nGGGGGG\nac\n>chrX\nCC\n>chr2\nAT\n")
    found = sorted(map(tuple, fasta.gc_windows(spark, str(path), 5).collect()))
    assert found == [("chr1", 0, 5, 0.6), ("chr1", 5, 10, 1.0), ("chr1", 10, 12, 0.5), ("chr2", 0, 2, 0.0)]
    assert fasta.gc_windows(spark, str(path), 5, autosomes_only=False).count() == 5


def test_gc_windows_of_many_pieces(spark, tmp_path):
    rng = random.Random(2)
    want, sizes = {}, {"chr1": 3000, "chr2": 10, "chr3": 0, "chr4": 2500}
    (tmp_path / "g").mkdir()
    for part, names in enumerate((("chr1", "chr2"), ("chr3", "chr4"))):
        text = ""
        for name in names:
            bases = "".join(rng.choices("ACGTN", k=sizes[name]))
            text += f">{name}\n" + "".join(bases[k : k + 60] + "\n" for k in range(0, len(bases), 60))
            want |= {(name, k, k + len(bases[k : k + 70])): round(sum(c in "GC" for c in bases[k : k + 70]) / len(bases[k : k + 70]), 9) for k in range(0, len(bases), 70)}
        (tmp_path / "g" / f"{part}.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = {(r.chrom, r.s, r.e): round(r.value, 9) for r in fasta.gc_windows(spark, str(tmp_path / "g"), 70).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == want


def test_region(chroms):
    assert tt.parse_region("chr2:1,000-2,000", chroms) == (1, 1000, 2000)
    assert tt.parse_region("2:5-9", chroms) == (1, 5, 9)
    assert tt.parse_region("chr9:1-2", chroms) is None and tt.parse_region("x", chroms) is None and tt.parse_region(None, chroms) is None


def test_tables_out(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456789, True, 5), ("b", None, False, None), ("c", float("nan"), None, 7), ("d", 1234567.0, True, 0), ("e", 2.0, True, 1)], "k string, x double, f boolean, n long")
    sinks.write_ordered(df, str(tmp_path / "t"), ["k"])
    text = joined(tmp_path / "t")
    assert text[0] == "k\tx\tf\tn" and text[1] == "a\t0.123457\t1\t5" and text[2] == "b\tNA\t0\tNA" and text[3] == "c\tNA\tNA\t7" and text[5] == "e\t2\t1\t1"
    assert float(text[4].split("\t")[1]) == pytest.approx(1234567, rel=1e-5)
    sinks.write_table(df, str(tmp_path / "u"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "u").glob("part*")]
    assert {p[0] for p in parts if p} == {text[0]} and sorted(x for p in parts for x in p[1:]) == text[1:]
    sinks.write_summary(spark, {"a": float("inf"), "b": [1, float("nan")]}, str(tmp_path / "s.json"))
    assert json.loads("\n".join(joined(tmp_path / "s.json"))) == {"a": None, "b": [1, None]}


def test_ordered_parts_are_one_file(spark, tmp_path):
    """Values decide the order, not what they are printed as; many parts, one head, nulls first, the same when written again."""
    rows = [(f"c{k % 7}", (k * 7919) % 5000 - 2500, k / 3) for k in range(5000)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "name string, n long, x double").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):
            sinks.write_ordered(df, str(tmp_path / "t"), ["n"], ["one", "two"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "t").glob("part*"))) > 1
    lines = joined(tmp_path / "t")
    assert lines[:4] == ["# one", "# two", "name\tn\tx", "NA\tNA\tNA"]
    want = sorted(rows[:-1], key=lambda r: r[1])
    assert [x.split("\t")[:2] for x in lines[4:]] == [[name, str(n)] for name, n, _ in want]
    assert all(float(x.split("\t")[2]) == pytest.approx(r[2], rel=1e-5) for x, r in zip(lines[4:], want))
    sinks.write_ordered(df, str(tmp_path / "e"), [-F.col("n"), "name"], header=False)
    assert [int(x.split("\t")[1]) for x in joined(tmp_path / "e")[1:]] == [n for _, n, _ in want[::-1]]
    sinks.write_ordered(df.limit(0), str(tmp_path / "z"), ["n"])
    assert joined(tmp_path / "z") == ["name\tn\tx"]


def test_track_is_read_again(spark, tmp_path, chroms):
    track = spark.createDataFrame([("chr2", 50, 100, -0.25), ("chr1", 0, 100, 0.5), ("chr2", 0, 50, 2.0)], "chrom string, s long, e long, value double")
    sinks.write_bedgraph(track, str(tmp_path / "t"), "a track")
    assert joined(tmp_path / "t") == ['track type=bedGraph name="a track"', "chr1\t0\t100\t0.5", "chr2\t0\t50\t2", "chr2\t50\t100\t-0.25"]
    assert sorted(map(tuple, tt.read_bedgraph(spark, str(tmp_path / "t"), chroms).collect())) == [(0, 0, 100, 0.5), (1, 0, 50, 2.0), (1, 50, 100, -0.25)]


def test_stream_of_events(spark, tmp_path):
    rows = [(c, 0, 100 * k) for c in range(3) for k in range(c + 2)]
    table = spark.createDataFrame(rows, "cell long, h int, p long")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = ingest.start_depth(stream, "depths", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("depths").collect())) == [(0, 2), (1, 3), (2, 4)]
    finally:
        query.stop()
    assert ingest.running_bins(table, 200).count() == 5


def test_merge_of_nothing(spark):
    none = spark.createDataFrame([], "h int, s long, e long")
    assert intervals.merge(none).collect() == []
