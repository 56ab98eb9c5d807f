"""BAM and block-gzipped text: every record and line once, wherever files are cut."""

import gzip
import random
import struct
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repliphase.sources import bam, bgzf
from repliphase.sources import text_tables as tt

REFS = [("c1", 50_000_000), ("c2", 50_000_000)]


def _record(name, ref, pos, payload=0, fill=b"\x11"):
    """A record of so many bases, one base of it aligned for each ten."""
    title = name.encode() + b"\0"
    cigar = struct.pack("<I", max(1, payload // 10) << 4)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(title), 6, 9, 1 if ref >= 0 else 0, 0, payload, -1, -1, 0) + title + (cigar if ref >= 0 else b"")
    half = (payload + 1) // 2
    body += (fill * (1 + half // len(fill)))[:half] + (fill * (1 + payload // len(fill)))[:payload]
    return struct.pack("<i", len(body)) + body


def _written(path, rows, block=None):
    whole = bam.header_of("@HD\n", REFS) + b"".join(rows)
    step = block or len(whole)
    path.write_bytes(b"".join(bgzf.compressed(whole[k : k + step], 1) for k in range(0, len(whole), step)) + bgzf.EOF_BLOCK)
    return str(path)


def _raw(df):
    return [bytes(r.raw) for r in df.collect()]


@pytest.fixture(scope="module")
def long_one(tmp_path_factory):
    """401 records, of which one has three million bases; what it holds looks in part like records."""
    rng = random.Random(1)
    rows = [_record(f"r{k}", k % 2, 1 + 100 * k, rng.randint(0, 200), rng.randbytes(50)) for k in range(400)]
    rows.insert(200, _record("long", 0, 5, 3_000_000, b"".join(rows[:7]) + rng.randbytes(997_001)))
    return _written(tmp_path_factory.mktemp("bam") / "long.bam", rows), rows


@pytest.mark.parametrize("split", [1 << 15, 123_457, 900_000, 1_800_000, 1 << 26])
def test_every_record_once(spark, long_one, split):
    path, rows = long_one
    found = bam.index(spark, path, split, granule=split)
    assert found.agg(F.sum("n")).first()[0] == len(rows)
    assert _raw(bam.read(spark, found=found, split=split, columns=["raw"])) == rows


@pytest.mark.parametrize("split", [97, 1000, 7919])
def test_records_across_small_blocks(spark, tmp_path, split):
    rows = [_record(f"r{k:04d}", 0, k + 1, 3 * k, bytes([k % 256])) for k in range(300)]
    path = _written(tmp_path / "b.bam", rows, 333)
    assert _raw(bam.read(spark, path, columns=["raw"], split=split, granule=split)) == rows


def test_a_wrong_beginning_is_walked_again(spark, tmp_path):
    """Whole records within a record, at the very beginning of a block, mislead the search; the check puts that right."""
    rng = random.Random(3)
    inner = b"".join(_record(f"i{k}", 1, 9, 40, rng.randbytes(40)) for k in range(2000))
    lead = bam.header_of("@HD\n", REFS) + b"".join(_record(f"a{k}", 0, k + 1, 30) for k in range(50))
    outer = _record("outer", 0, 77, 2 * len(inner), inner)
    tail = b"".join(_record(f"z{k}", 1, k + 1, 30) for k in range(50))
    whole, at = lead + outer + tail, len(lead) + 36 + 6 + 4
    cuts = [0, *range(at, at + len(inner), 5000), len(whole)]
    path = tmp_path / "w.bam"
    path.write_bytes(b"".join(bgzf.compressed(whole[a:b]) for a, b in zip(cuts, cuts[1:])) + bgzf.EOF_BLOCK)
    misled = [next(iter(bam._records(str(path), start, start + 2000, None, 2)), (0, b""))[1][36:37] for start in range(2000, path.stat().st_size, 2000)]
    assert b"i" in misled
    for split in (2000, 20_000):
        got = bam.read(spark, str(path), columns=["name"], split=split, granule=split).collect()
        assert [r.name for r in got] == [*(f"a{k}" for k in range(50)), "outer", *(f"z{k}" for k in range(50))]


def test_columns_and_region(spark, long_one):
    path, _ = long_one
    found = bam.index(spark, path, 100_000, granule=1).cache()
    all_rows = bam.read(spark, found=found, columns=["name", "chrom", "pos", "stop"]).collect()
    for chrom, start, end in (("c1", 0, 50), ("c2", 10_000, 12_000), ("c1", 299_000, 301_000), ("c2", 10**7, 10**8), ("nowhere", 0, 9)):
        want = [r.name for r in all_rows if r.chrom == chrom and r.pos <= end and r.stop > start]
        got = bam.read(spark, found=found, region=(chrom, start, end), columns=["name"])
        assert got.columns == ["name"] and [r.name for r in got.collect()] == want
    region = ("c2", 38_000, 39_500)
    touched = bam.granules(found, region).collect()
    assert 0 < len(touched) < found.select("begin").distinct().count()
    # What is read lies within those granules: with all else of the file overwritten the rows are the same.
    data = bytearray(open(path, "rb").read())
    first = min(r.begin >> 16 for r in touched)
    second = [at for at, _ in bgzf.blocks(path, 0)][1]  # the first block holds the header
    data[second:first] = bytes(first - second)
    with open(path + ".cut", "wb") as out:
        out.write(data)
    moved = found.withColumn("file", F.lit(path + ".cut"))
    want = [r.name for r in all_rows if r.chrom == region[0] and r.pos <= region[2] and r.stop > region[1]]
    assert want and first > 2 * second
    assert [r.name for r in bam.read(spark, found=moved, region=region, columns=["name"]).collect()] == want


def test_values(spark, bam_file):
    rows = bam.read(spark, str(bam_file))
    assert rows.count() == 3001
    r = rows.where("name = 'r1'").first()
    assert (r.chrom, r.pos, r.stop, r.mapq, r.cigar, r.tags) == ("chr2", 101, 108, 30, "5M2I3D", ["CB:Z:BB"])
    u = rows.where("name = 'u'").first()
    assert (u.chrom, u.pos, u.cigar) == ("*", 0, "*")
    with pytest.raises(ValueError, match="unknown columns"):
        bam.read(spark, str(bam_file), columns=["bases"])


def test_filter_and_several_files(spark, bam_file, tmp_path):
    wanted = spark.createDataFrame([("AA",), ("AA",), ("ZZ",)], "barcode string")
    kept = bam.filter_bam(spark, str(bam_file), str(tmp_path / "out"), wanted, split=10_000)
    assert kept.count() == 1000 and {t for r in kept.collect() for t in r.tags} == {"CB:Z:AA"}
    assert [r.name for r in kept.collect()] == [f"r{k}" for k in range(0, 3000, 3)]
    files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    assert len(files) > 1 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_aside")]
    assert all(gzip.decompress(f.read_bytes())[:4] == b"BAM\1" for f in files)
    with pytest.raises(Exception, match="holds files already"):
        bam.filter_bam(spark, str(bam_file), str(tmp_path / "out"), wanted)
    assert bam.filter_bam(spark, str(bam_file), f"file://{tmp_path}/out", wanted.limit(0), mode="overwrite").count() == 0


def test_a_failed_job_leaves_nothing(spark, bam_file, tmp_path):
    rows = bam.read(spark, str(bam_file), columns=["raw", "name"], split=3000, granule=3000)
    broken = rows.withColumn("raw", F.when(F.col("name") == "r2900", F.raise_error(F.lit("no"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="no"):
        bam.write(broken, str(tmp_path / "out"), bam.Header(str(bam_file)).raw)
    with pytest.raises(ValueError, match="no files"):
        bgzf.files(str(tmp_path / "out"))


def test_written_records_read_back(spark, tmp_path):
    rows = [("a", 0, "c1", 7, 30, "5M2I3D", ["CB:Z:é", "NM:i:3"]), (None, 4, "*", 0, 0, "*", None), ("b", 16, "x", 9, 1, None, ["XX:Z:"])]
    df = spark.createDataFrame(rows, "name string, flag int, chrom string, pos long, mapq int, cigar string, tags array<string>")
    bam.write(bam.encode(df.coalesce(1), REFS), str(tmp_path / "e"), bam.header_of("@HD", REFS))
    got = bam.read(spark, str(tmp_path / "e"), columns=["name", "flag", "chrom", "pos", "stop", "mapq", "cigar", "tags"]).collect()
    assert [tuple(r) for r in got] == [("a", 0, "c1", 7, 14, 30, "5M2I3D", ["CB:Z:é"]), ("*", 4, "*", 0, 0, 0, "*", []), ("b", 16, "*", 9, 9, 1, "*", ["XX:Z:"])]


def test_no_records_and_no_bam(spark, tmp_path):
    assert bam.read(spark, _written(tmp_path / "n.bam", [])).collect() == []
    (tmp_path / "x.bam").write_bytes(bgzf.compressed(b"no") + bgzf.EOF_BLOCK)
    with pytest.raises(Exception, match="no BAM file"):
        bam.read(spark, str(tmp_path / "x.bam")).collect()
    with pytest.raises(ValueError, match="no files"):
        bgzf.files(str(tmp_path / "absent"))


@pytest.fixture(scope="module")
def text_file(tmp_path_factory):
    """Lines of every length, empty ones, all line ends, and a last one that is not ended."""
    rng = random.Random(7)
    ends = ["\n"] * 8 + ["\r\n", "\r"]
    text = "".join("".join(rng.choices("abcdé\t", k=rng.choice([0, 1, 5, 40, 300]))) + rng.choice(ends) for _ in range(3000))
    text += "x" * 400_000 + "\n\n" + "y" * 150_000 + "\n" + "last"
    path = tmp_path_factory.mktemp("text") / "t.tsv.gz"
    raw = text.encode()
    cuts = sorted({0, len(raw), *rng.sample(range(len(raw)), 400)})
    path.write_bytes(b"".join(bgzf.compressed(raw[a:b]) for a, b in zip(cuts, cuts[1:])) + bgzf.EOF_BLOCK)
    return str(path)


@pytest.mark.parametrize("split", [500, 5000, 20_000, 1 << 26])
def test_lines_are_those_of_spark(spark, text_file, split):
    want = [r.value for r in spark.read.text(text_file).collect()]
    lines = bgzf.read_lines(spark, text_file, split)
    assert [r.value for r in lines.collect()] == want
    if split < 20_000:
        assert lines.rdd.getNumPartitions() > 4 > spark.read.text(text_file).rdd.getNumPartitions()


def test_fragments_from_blocks(spark, tmp_path):
    lines = ["#c", "chrom\tstart\tend\tbarcode\tn", *(f"chr1\t{k}\t{k + 5}\tb{k % 3}\t1" for k in range(5000)), "", "chr1\tx\t9\t\t1"]
    with gzip.open(tmp_path / "plain.tsv.gz", "wt") as out:
        out.write("\n".join(lines) + "\n")
    bgzf.write_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), str(tmp_path / "folder"))
    file = next((tmp_path / "folder").glob("part-*.gz"))
    file.rename(tmp_path / "blocks.tsv.gz")
    plain, blocked = (tt.read_fragments(spark, str(tmp_path / n), split=2000) for n in ("plain.tsv.gz", "blocks.tsv.gz"))
    assert not tt._blocked(str(tmp_path / "plain.tsv.gz")) and tt._blocked(str(tmp_path / "blocks.tsv.gz"))
    names = ("chrom", "s", "e", "barcode")
    rows = [tuple(r) for r in blocked.orderBy("seq").select(*names).collect()]
    assert rows == [tuple(r) for r in plain.orderBy("seq").select(*names).collect()] and len(rows) == 5001
    assert blocked.rdd.getNumPartitions() > 2


def _calls(work) -> int:
    """How many Python and C functions are called from Python code meanwhile."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def test_records_are_worked_on_together(spark, tmp_path):
    """A record brings no more than the two calls that step over it, once for the index and once for its columns."""
    n = 20_000
    rows = spark.range(n).selectExpr("cast(id as string) as name", "0 as flag", "'c1' as chrom", "id + 1 as pos", "30 as mapq", "concat(id % 50, 'M2D', id % 7, 'S') as cigar", "array('NM:i:0', concat('CB:Z:', id % 9)) as tags")
    bam.write(bam.encode(rows.coalesce(1), REFS), str(tmp_path / "m"), bam.header_of("@HD\n", REFS))
    path = bgzf.files(str(tmp_path / "m"))[0][0]
    first = bam.Header(path).first
    piece = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([0]), pa.array([0]), pa.array([1 << 40]), pa.array([None], pa.int64())], names=["file", "piece", "start", "stop", "entry"])
    granule = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first]), pa.array([bam._END])], names=["file", "begin", "until"])
    found, parsed = [], []
    assert _calls(lambda: found.extend(bam._walk(1 << 20)([piece]))) < 3 * n
    assert _calls(lambda: parsed.extend(bam._parse(["name", "stop", "cigar", "tags", "raw"])([granule]))) < 3 * n
    assert sum(found[0].column(7).to_pylist()) == n
    got = pa.Table.from_batches(parsed).to_pylist()
    assert [(r["name"], r["stop"], r["cigar"], r["tags"]) for r in got] == [(str(k), k + max(1, k % 50 + 2), f"{k % 50}M2D{k % 7}S", [f"CB:Z:{k % 9}"]) for k in range(n)]
    columns = pa.table(rows.toArrow()).combine_chunks().to_batches()[0].columns
    made = []
    assert _calls(lambda: made.append(bam.encoded(columns, pa.array(["c1", "c2"])))) < n
    assert made[0].to_pylist() == [r["raw"] for r in got]


def test_tags_of_all_kinds_and_odd_operations(spark, tmp_path):
    head = struct.pack("<iiBBHHHiiii", 0, 9, 2, 6, 9, 0, 0, 3, -1, -1, 0) + b"q\0" + b"\x11\x11" + b"\xff\xff\xff"
    tails = [
        (b"NMi" + struct.pack("<i", 7) + b"BBBs" + struct.pack("<ihh", 2, 0, 0) + b"AAZx y\0XHHff\0CCZ\0", ["AA:Z:x y", "CC:Z:"]), (b"", []),
        (b"ZZZ\xc3\xa9\0AAAqBBBC" + struct.pack("<i", 0) + b"FFf" + struct.pack("<f", 1), ["ZZ:Z:é"]), (b"CBZa\0", ["CB:Z:a"]),
    ]
    rows = [struct.pack("<i", len(head + t)) + head + t for t, _ in tails]
    got = bam.read(spark, _written(tmp_path / "t.bam", rows), columns=["tags", "raw", "stop", "cigar"]).collect()
    assert [(r.tags, bytes(r.raw), r.stop, r.cigar) for r in got] == [(want, raw, 10, "*") for (_, want), raw in zip(tails, rows)]
    odd = ["3M4", "M5I", "12MM3D", "7Q8X", "0005N", "", "1M*2S"]
    df = spark.createDataFrame([(str(k), c) for k, c in enumerate(odd)], "name string, cigar string").coalesce(1)
    df = df.selectExpr("name", "0 as flag", "'c2' as chrom", "5L as pos", "1 as mapq", "cigar", "array() as tags")
    bam.write(bam.encode(df.withColumn("tags", F.col("tags").cast("array<string>")), REFS), str(tmp_path / "o"), bam.header_of("", REFS))
    assert [r.cigar for r in bam.read(spark, str(tmp_path / "o"), columns=["cigar"]).collect()] == ["3M", "5I", "12M3D", "8X", "5N", "*", "1M2S"]


def test_filtered_records_are_dealt_without_reading_them_first(spark, bam_file, tmp_path, monkeypatch):
    plans, write = [], bam.write
    monkeypatch.setattr(bam, "write", lambda rows, *more: (plans.append(rows._jdf.queryExecution().toString()), write(rows, *more)))
    wanted = spark.createDataFrame([("AA",)], "barcode string")
    kept = bam.filter_bam(spark, str(bam_file), str(tmp_path / "f"), wanted, split=10_000, columns=("name", "mapq"))
    assert [r.name for r in kept.collect()] == [f"r{k}" for k in range(0, 3000, 3)]
    assert "rangepartitioning(at" not in plans[0]
