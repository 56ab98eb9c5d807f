import struct
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from repliphase.session import get_session

    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def record(name, ref, pos, mapq, cigar, tags):
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(cigar), 0, 4, -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar) + b"\x11\x22" + b"\xff" * 4 + tags
    return struct.pack("<i", len(body)) + body


@pytest.fixture
def bam_file(tmp_path):
    from repliphase.sources import bgzf

    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2)
    for name in ("chr1", "chr2"):
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", 5_000_000)
    tag = lambda b: b"NMi" + struct.pack("<i", 3) + b"BQBc" + struct.pack("<i", 2) + b"\1\2" + b"CBZ" + b + b"\0"
    rows = [record(f"r{k}", k % 2, 100 + k, 30, [(5, "M"), (2, "I"), (3, "D")], tag([b"AA", b"BB", b"-"][k % 3])) for k in range(3000)]
    rows.append(record("u", -1, 0, 0, [], b""))
    path = tmp_path / "a.bam"
    path.write_bytes(bgzf.compressed(head + b"".join(rows)) + bgzf.EOF_BLOCK)
    return path
