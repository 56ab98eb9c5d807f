"""BAM files: an index of their records, reading by it, and a sink.

``index`` makes, in one distributed pass, a table of granules: stretches of whole records with their
place in the file and, for each chromosome, the range that they cover. It can be written and read like any
table. A task of that pass does not know where the first record of its piece begins; it takes the first place
from which a run of well-formed records follows. That is checked, not trusted: where a piece ends
must be where the next one begins, else that piece is walked again from the right place. So every record
is read exactly once, however long it is and wherever files are cut.

``read`` takes the granules that a region touches, a task for each ``split`` bytes of them, and parses
only the columns asked for. The sink (``format("bam")``) writes a folder of complete BAM files, one
a task; they appear when all tasks are done, and not at all if one fails.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from repliphase.functions.storage import settled
from repliphase.session import ship
from repliphase.sources import bgzf

# Fixed values of the format: CIGAR operations by code, those that cover the reference, and sizes of tag types.
_OPS, _COVER = "MIDNSHP=X", frozenset((0, 2, 3, 7, 8))
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: How many well-formed records in a row make a beginning.
_SURE = 8
#: Compressed bytes of a granule.
GRANULE = 1 << 20

COLUMNS = {
    "place": "long", "name": "string", "flag": "int", "chrom": "string", "pos": "long", "stop": "long", "mapq": "int", "cigar": "string", "tags": "array<string>", "raw": "binary",
}


class Header:
    """A file's header: its bytes, the names and sizes of its references, and the place of the first record."""

    def __init__(self, path: str):
        window = bgzf.Window(path, 0)

        def take(n: int) -> bytes:
            if not window.reach(self._at + n):
                raise ValueError(f"{path} is no BAM file, or its header is cut off")
            self._at += n
            return bytes(window.data[self._at - n : self._at])

        self._at, self.chroms = 0, []
        if take(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        take(struct.unpack("<i", take(4))[0])
        for _ in range(struct.unpack("<i", take(4))[0]):
            name = take(struct.unpack("<i", take(4))[0])[:-1].decode()
            self.chroms.append((name, struct.unpack("<i", take(4))[0]))
        self.raw, self.names = bytes(window.data[: self._at]), [n for n, _ in self.chroms]
        self.first = _place(window, self._at)


def header_of(text: str, chroms: list[tuple[str, int]]) -> bytes:
    """The bytes of a header with this text and these references."""
    raw = text.encode()
    refs = [struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in chroms]
    return b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs)) + b"".join(refs)


_END = (1 << 62) - 1


def _place(window: bgzf.Window, at: int) -> int:
    """The place in the file of the byte ``at``, which may be the next to come; the largest place at the end of the file."""
    if not window.reach(at + 1):
        return _END
    block, inside = window.offset(at)
    return block << 16 | inside


def _size_at(window: bgzf.Window, at: int, refs: int) -> int:
    """The size of a well-formed record at this byte, 0 if there is none."""
    if not window.reach(at + 36):
        return 0
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", window.data, at)
    if not (32 <= size < 1 << 30 and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name and l_seq >= 0):
        return 0
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size or not window.reach(at + 36 + l_name):
        return 0
    name = window.data[at + 36 : at + 36 + l_name]
    return 0 if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]) else size + 4


def _begins(window: bgzf.Window, at: int, refs: int) -> bool:
    """Whether a run of well-formed records, or the last ones of the file, begin at this byte."""
    n = 0
    while n < _SURE and (size := _size_at(window, at, refs)):
        at, n = at + size, n + 1
        if not window.reach(at):
            return False
    return n == _SURE or (n > 0 and at == len(window.data) and not window.grow())


def _first(window: bgzf.Window, stop: int, refs: int) -> int | None:
    """The first byte of a block before ``stop`` at which records begin."""
    at = 0
    while window.reach(at + 36):
        if window.offset(at)[0] >= stop:
            return None
        # What a record's size and references allow narrows the places down.
        head = np.frombuffer(bytes(window.data[at:]), np.uint8)
        count = len(head) - 35
        size, ref = (head[k : k + count].astype(np.int64) | head[k + 1 : k + 1 + count].astype(np.int64) << 8 | head[k + 2 : k + 2 + count].astype(np.int64) << 16 | head[k + 3 : k + 3 + count].astype(np.int64) << 24 for k in (0, 4))
        ref = np.where(ref >= 1 << 31, ref - (1 << 32), ref)
        for k in np.flatnonzero((size >= 32) & (size < 1 << 30) & (ref >= -1) & (ref < refs) & (head[12 : 12 + count] > 0)).tolist():
            if window.offset(at + k)[0] >= stop:
                return None
            if _begins(window, at + k, refs):
                return at + k
        at = window.drop(at + count)
    return None


#: Bytes of whole records that are gone through at a time.
_STRETCH = 1 << 21
_SIZE = struct.Struct("<i")
_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("span", "<i4")])


def _stretches(path: str, start: int, stop: int, entry: int | None, refs: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, where each record begins in them and the last one ends, places of these) of the records that begin in blocks from ``start`` to ``stop``.

    The last place is that of what follows. With an ``entry``, the place of the first record, nothing is searched.
    """
    window = bgzf.Window(path, start if entry is None else entry >> 16, entry is not None)
    at = _first(window, stop, refs) if entry is None else entry & 0xFFFF
    if at is None:
        return
    more = True
    while more:
        end = window.fill(at + _STRETCH, stop)
        data, n, begins = window.data, len(window.data), [at]
        while at < end:
            size = _SIZE.unpack_from(data, at)[0] + 4 if at + 4 <= n else 4
            if size < 36 and at + 4 <= n:
                raise ValueError(f"{path} holds a record of {size} bytes")
            if at + 4 > n or at + size > n:
                if len(begins) > 1:
                    break  # what is whole goes first
                if not window.reach(at + 4) or not window.reach(at + 4 + _SIZE.unpack_from(data, at)[0]):
                    raise ValueError(f"{path} is cut off in a record")
                end, n = window.fill(0, stop), len(data)
            at += size
            begins.append(at)
        # A record that ends with the bytes held may be the last of the file, or be followed by a block beyond the stop.
        place = _place(window, at)
        more = place != _END and place >> 16 < stop
        begins = np.array(begins, np.int64)
        places = window.places(begins)
        places[-1] = place
        yield bytes(window.data[begins[0] : at]), begins - begins[0], places
        at = window.drop(at)


def _records(path: str, start: int, stop: int, entry: int | None, refs: int) -> Iterator[tuple[int, bytes]]:
    """(place, record with its size before it) of the records of ``_stretches``, then (place, b"") of what follows."""
    place = None
    for raw, at, places in _stretches(path, start, stop, entry, refs):
        yield from zip(places[:-1].tolist(), (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())))
        place = int(places[-1])
    if place is not None:
        yield place, b""


def _heads(buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fixed fields of the records that begin there."""
    return np.ascontiguousarray(buf[begin[:, None] + np.arange(36)]).view(_HEAD).ravel()


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, so many of each, one run after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _ints(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(buf[at[:, None] + np.arange(4)]).view("<u4").ravel()


def _operations(buf: np.ndarray, begin: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The CIGAR operations of the records, one record's after the other's."""
    first = np.repeat(begin + 36 + head["l_name"], head["n_cigar"])
    return _ints(buf, first + 4 * _runs(np.zeros(len(begin), np.int64), head["n_cigar"].astype(np.int64)))


def _stops(buf: np.ndarray, begin: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The base after the last of each record; one base at least."""
    ops = _operations(buf, begin, head).astype(np.int64)
    covered = np.where(np.isin(ops & 15, list(_COVER)), ops >> 4, 0)
    so_far, last = np.r_[0, np.cumsum(covered)], np.cumsum(head["n_cigar"].astype(np.int64))
    return head["pos"] + np.maximum(1, so_far[last] - so_far[last - head["n_cigar"]])


_INDEX = "file string, piece long, begin long, until long, chrom string, lo long, hi long, n long"


def _walk(granule: int):
    """Rows (file, piece, start, stop, entry) of pieces to rows of _INDEX; one with a null begin if no record begins in a piece."""

    def work(batches):
        for batch in batches:
            for file, piece, start, stop, entry in zip(*(batch.column(k).to_pylist() for k in range(5))):
                header = Header(file)
                entry = header.first if start == 0 else entry
                out, begin, spans, place = [], None, {}, None

                def close(until: int) -> None:
                    out.extend((file, piece, begin, until, header.names[r] if r >= 0 else "*", lo, hi, n) for r, (lo, hi, n) in spans.items())
                    spans.clear()

                for raw, at, places in _stretches(file, start, stop, entry, len(header.names)) if entry is None or entry >> 16 < stop else iter(()):
                    place = int(places[-1])
                    buf, where, block = np.frombuffer(raw, np.uint8), at[:-1], places[:-1] >> 16
                    head = _heads(buf, where)
                    ref, lo, hi, k = head["ref"], head["pos"], _stops(buf, where, head), 0
                    while k < len(where):
                        if begin is None or block[k] - (begin >> 16) >= granule:
                            close(int(places[k]))
                            begin = int(places[k])
                        after = int(np.searchsorted(block, (begin >> 16) + granule))
                        for r in np.unique(ref[k:after]).tolist():
                            own = ref[k:after] == r
                            low, high = int(lo[k:after][own].min()), int(hi[k:after][own].max())
                            old = spans.get(r, (low, high, 0))
                            spans[r] = (min(low, old[0]), max(high, old[1]), old[2] + int(own.sum()))
                        k = after
                close(place)
                out = out or [(file, piece, None, None, None, None, None, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 3))], names=_INDEX.replace(" string", "").replace(" long", "").split(", "))

    return work


def index(spark: SparkSession, path: str, split: int = bgzf.SPLIT, granule: int = GRANULE) -> DataFrame:
    """Rows (file, number, piece, begin, until, chrom, lo, hi, n): the records of each granule on each chromosome.

    Records from place ``begin`` up to ``until`` make a granule; on ``chrom`` they cover bases ``lo`` to ``hi``,
    from 0 and half-open (``*``: unplaced). ``number`` orders the files.
    """
    ship(spark)
    parts = settled(bgzf.pieces(spark, path, split).withColumn("entry", F.lit(None).cast("long")))

    def walked(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(max(1, rows.count()), "number", "piece")
        return settled(dealt.select("file", "piece", "start", "stop", "entry").mapInArrow(_walk(granule), _INDEX))

    found = walked(parts)
    while True:
        # Where the walk of all pieces before has come to, and whether this piece went on from there.
        ends = parts.join(found.groupBy("file", "piece").agg(F.min("begin").alias("begin"), F.max("until").alias("until")), ["file", "piece"])
        along = Window.partitionBy("file").orderBy("piece")  # a row per piece
        ends = ends.withColumn("come", F.max("until").over(along.rowsBetween(Window.unboundedPreceding, -1)))
        due = F.expr(f"come <> {_END} and shiftright(come, 16) < stop")
        wrong = ends.where("come is not null").where(~F.when(due, F.coalesce(F.col("begin") == F.col("come"), F.lit(False))).otherwise(F.col("begin").isNull()))
        first = settled(wrong.groupBy("file").agg(F.min(F.struct("piece", "come")).alias("w")).select("file", F.col("w.piece").alias("since"), F.col("w.come").alias("entry")))
        if not first.take(1):
            break
        # The first wrong piece of a file, and those that a record which covers it covers too.
        redo = settled(parts.drop("entry").join(first, "file").where("piece >= since and start <= shiftright(entry, 16)"))
        found = settled(found.join(redo, ["file", "piece"], "left_anti").unionByName(walked(redo)))
    return found.where("begin is not null").join(parts.select("file", "number").distinct(), "file").select("file", "number", "piece", "begin", "until", "chrom", "lo", "hi", "n")


def granules(found: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Rows (number, file, begin, until) of an index, one per granule, of those that records in the region may lie in."""
    if region:
        chrom, start, end = region
        found = found.where((F.col("chrom") == chrom) & (F.col("lo") < end) & (F.col("hi") > start))
    return found.select("number", "file", "begin", "until").distinct()


def read(
    spark: SparkSession, path: str | None = None, *, columns: list[str] | None = None, region: tuple[str, int, int] | None = None,
    found: DataFrame | None = None, split: int = bgzf.SPLIT, granule: int = GRANULE,
) -> DataFrame:
    """The records of BAM files in their order, of a region (chromosome, first base from 0, base after the last) if given.

    Columns, of which only those named are parsed: place (in the file), name, flag, chrom, pos (from 1, 0 if
    unplaced), stop (the base after the last, from 0), mapq, cigar, tags (``TAG:Z:VALUE`` of string
    tags), and raw, the record's bytes. ``found`` is an index of the files; without one it is made.
    """
    names = list(columns or COLUMNS)
    if unknown := set(names) - set(COLUMNS):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    ship(spark)
    rows = settled(granules(index(spark, path, split, granule) if found is None else found, region))
    tasks = _tasks(rows, split, granule)
    needed = [*names, *[c for c in ("chrom", "pos", "stop") if region and c not in names]]
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in needed)
    out = bgzf.in_order(rows, tasks, "number", "begin").select("file", "begin", "until").mapInArrow(_parse(needed), schema)
    if region:
        chrom, start, end = region
        out = out.where((F.col("chrom") == chrom) & (F.col("pos") <= end) & (F.col("stop") > start))
    return out.select(*names)


def _tasks(rows: DataFrame, split: int, granule: int = GRANULE) -> int:
    """How many tasks read these granules."""
    size = F.expr(f"case when until = {_END} then {granule} else shiftright(until, 16) - shiftright(begin, 16) end")
    n, held = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return min(n, -(-held // split))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _parse(names: list[str]):
    """Rows (file, begin, until) to batches of the records' columns."""

    def batch(raw: bytes, at: np.ndarray, places: np.ndarray, refs: list[str]) -> pa.RecordBatch:
        buf, begin = np.frombuffer(raw, np.uint8), at[:-1]
        head = _heads(buf, begin)
        made = {}
        for name in names:
            if name == "place":
                made[name] = pa.array(places)
            elif name == "raw":
                made[name] = _strings(at, buf, pa.binary())
            elif name == "name":
                size = np.maximum(head["l_name"].astype(np.int64) - 1, 0)
                made[name] = _strings(np.r_[0, np.cumsum(size)], buf[_runs(begin + 36, size)])
            elif name == "chrom":
                made[name] = pa.array([*refs, "*"], pa.string()).take(pa.array(np.where(head["ref"] >= 0, head["ref"], len(refs))))
            elif name == "stop":
                made[name] = pa.array(_stops(buf, begin, head))
            elif name == "cigar":
                made[name] = _cigars(buf, begin, head)
            elif name == "tags":
                made[name] = _tags(buf, at, head)
            else:
                made[name] = pa.array({"flag": head["flag"].astype(np.int32), "pos": head["pos"].astype(np.int64) + 1, "mapq": head["mapq"].astype(np.int32)}[name])
        return pa.RecordBatch.from_arrays([made[c].cast(_ARROW[COLUMNS[c]]) for c in names], names=names)

    def work(batches):
        headers: dict[str, list[str]] = {}
        for some in batches:
            for file, begin, until in zip(*(some.column(k).to_pylist() for k in range(3))):
                refs = headers.get(file) or headers.setdefault(file, Header(file).names)
                for raw, at, places in _stretches(file, 0, (until >> 16) + 1, begin, len(refs)):
                    n = int(np.searchsorted(places[:-1], until))
                    if n:
                        yield batch(raw, at[: n + 1], places[:n], refs)
                    if places[-1] >= until:
                        break

    return work


def _strings(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Texts, or values of this kind, that lie one after the other."""
    out = pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    if kind is None:
        out.validate(full=True)
    return out


def _cigars(buf: np.ndarray, begin: np.ndarray, head: np.ndarray) -> pa.Array:
    found, back = np.unique(_operations(buf, begin, head), return_inverse=True)
    texts = [*(f"{x >> 4}{_OPS[x & 15]}".encode() for x in found.tolist()), b"*"]
    n = head["n_cigar"].astype(np.int64)
    # A record without operations has the last text.
    which = np.full(int(np.maximum(n, 1).sum()), len(texts) - 1)
    last = np.cumsum(np.maximum(n, 1))
    which[_runs(last - np.maximum(n, 1), n)] = back
    size = np.array([len(x) for x in texts])
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)[_runs(first[which], size[which])]
    return _strings(np.r_[0, np.cumsum(size[which])][np.r_[0, last]], data)


def _tags(buf: np.ndarray, at: np.ndarray, head: np.ndarray) -> pa.Array:
    """The string tags of the records as lists; all records go from tag to tag together."""
    bases = head["l_seq"].astype(np.int64)
    here = at[:-1] + 36 + head["l_name"] + 4 * head["n_cigar"].astype(np.int64) + (bases + 1) // 2 + bases
    zeros, end, live = np.r_[np.flatnonzero(buf == 0), len(buf)], at[1:], np.arange(len(at) - 1)
    sizes = np.zeros(256, np.int64)
    sizes[[ord(k) for k in _SIZES]] = list(_SIZES.values())
    rows, tag, stop = [], [], []
    while len(live := live[here[live] + 3 <= end[live]]):
        begin = here[live]
        kind, value = buf[begin + 2], begin + 3
        after = value + sizes[kind]
        text, many = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        after[text] = zeros[np.searchsorted(zeros, value[text])] + 1
        if many.any():
            first = value[many]
            if (first + 5 > end[live][many]).any():
                raise ValueError("a record is cut off in its tags")
            after[many] = first + 5 + sizes[buf[first]] * _ints(buf, first + 1).astype(np.int32)
        if (after <= value).any() or (after > end[live]).any():
            raise ValueError("a record has tags of unknown kind, or is cut off in them")
        own = kind == ord("Z")
        rows.append(live[own])
        tag.append(begin[own])
        stop.append(after[own] - 1)
        here[live] = after
    rows, tag, stop = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (rows, tag, stop))
    by = np.argsort(rows, kind="stable")
    tag, size = tag[by], (stop - tag)[by] - 3
    offsets = np.r_[0, np.cumsum(size + 5)]
    data = np.empty(offsets[-1], np.uint8)
    first = offsets[:-1]
    data[first], data[first + 1] = buf[tag], buf[tag + 1]
    data[first + 2], data[first + 3], data[first + 4] = b":Z:"
    data[_runs(first + 5, size)] = buf[_runs(tag + 3, size)]
    lists = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(at) - 1))]
    return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), _strings(offsets, data))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of texts; those of a null are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return offsets, data


def _parsed_cigars(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many operations each text has, and all of them: a number and the letter right after it."""
    offsets, data = _bytes_of(cigars)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    codes = np.full(256, -1)
    codes[list(_OPS.encode())] = np.arange(len(_OPS))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    digit = (data >= 48) & (data <= 57)
    after_digit = np.r_[False, digit[:-1]][: len(data)] & ~first[:-1]
    op = np.flatnonzero((codes[data] >= 0) & after_digit)
    # The digits before each of these letters: from the last byte that is none, or from the text's beginning.
    along = np.arange(len(data))
    since = np.maximum.accumulate(np.where(~digit, along + 1, np.where(first[:-1], along, 0)))[op - 1]
    size = op - since
    power, value = _runs(np.zeros(len(op), np.int64), size), data[_runs(since, size)].astype(np.int64) - 48
    power = np.repeat(size, size) - 1 - power
    if ((power > 8) & (value > 0)).any():
        raise ValueError("a CIGAR operation is longer than a record can hold")
    so_far, last = np.r_[0, np.cumsum(value * 10 ** np.minimum(power, 8))], np.cumsum(size)
    length = so_far[last] - so_far[last - size]
    if (length >= 1 << 28).any():
        raise ValueError("a CIGAR operation is longer than a record can hold")
    return np.diff(np.searchsorted(op, offsets)), (length << 4 | codes[data[op]]).astype("<u4")


def encoded(batch: list[pa.Array], numbers: pa.Array) -> pa.Array:
    """Records without bases of columns name, flag, chrom, pos, mapq, cigar and tags; ``pos`` from 1, tags as ``TAG:Z:VALUE`` (others are left out).

    ``numbers`` are the names of the references in their order.
    """
    names, flag, chrom, pos, mapq, cigars, tags = batch
    n = len(names)
    title_at, titles = _bytes_of(pc.if_else(pc.equal(pc.fill_null(names, ""), ""), "*", names))
    l_title = np.minimum(np.diff(title_at), 254)
    n_ops, ops = _parsed_cigars(cigars)
    # Tags one after the other, with the row of each.
    flat, parent = tags.flatten(), pc.list_parent_indices(tags).to_numpy()
    tag_at, text = _bytes_of(flat)
    begin, size = tag_at[:-1], np.diff(tag_at)
    own = np.flatnonzero(size >= 5)
    own = own[(text[begin[own] + 2] == 58) & (text[begin[own] + 3] == 90) & (text[begin[own] + 4] == 58)] if len(own) else own
    begin, parent, l_value = begin[own], parent[own].astype(np.int64), size[own] - 5
    l_tags = np.bincount(parent, l_value + 4, n).astype(np.int64)
    length = 36 + l_title + 1 + 4 * n_ops + l_tags
    at = np.r_[0, np.cumsum(length)]
    head = np.zeros(n, _HEAD)
    ref = pc.fill_null(pc.index_in(chrom, value_set=numbers), -1).to_numpy()
    head["mate"], head["mate_pos"], head["bin"] = -1, -1, 4680
    given = {"size": length - 4, "ref": ref, "l_name": l_title + 1, "n_cigar": n_ops}
    given |= {name: pc.fill_null(x, 0).to_numpy() for name, x in (("pos", pos), ("mapq", mapq), ("flag", flag))}
    given["pos"] = given["pos"] - 1
    for name, x in given.items():
        most = np.iinfo(_HEAD[name])
        if n and not most.min <= x.min() <= x.max() <= most.max:
            raise ValueError(f"{name} is out of what a record can hold")
        head[name] = x
    out, first = np.zeros(at[-1], np.uint8), at[:-1]
    out[first[:, None] + np.arange(36)] = head.view(np.uint8).reshape(n, 36)
    out[_runs(first + 36, l_title)] = titles[_runs(title_at[:-1], l_title)]
    out[_runs(first + 37 + l_title, 4 * n_ops)] = ops.view(np.uint8)
    before = np.cumsum(l_value + 4) - (l_value + 4)
    started = np.cumsum(l_tags) - l_tags
    tag = (first + 37 + l_title + 4 * n_ops)[parent] + before - started[parent]
    out[tag], out[tag + 1], out[tag + 2] = text[begin], text[begin + 1], 90
    out[_runs(tag + 3, l_value)] = text[_runs(begin + 5, l_value)]
    return _strings(at, out, pa.binary())


def encode(rows: DataFrame, chroms: list[tuple[str, int]]) -> DataFrame:
    """Rows (raw) of records (name, flag, chrom, pos, mapq, cigar, tags); a chromosome that is not among these is ``*``."""
    numbers = pa.array([name for name, _ in chroms], pa.string())
    ship(rows.sparkSession)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([encoded(b.columns, numbers)], names=["raw"])

    return rows.selectExpr("name", "cast(flag as int)", "chrom", "cast(pos as long)", "cast(mapq as int)", "cigar", "tags").mapInArrow(work, "raw binary")


class BamSink(DataSource):
    """Writes rows with a column raw as BAM files. Options: path, a folder, and header, a header's bytes in hexadecimal."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "raw binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return bgzf.Writer(self.options["path"], overwrite, "raw", bytes.fromhex(self.options["header"]), b"", ".bam")


def write(rows: DataFrame, target: str, header: bytes, mode: str = "errorifexists") -> None:
    """Writes rows (raw, ...) as a folder of BAM files with this header; they keep the order of the rows."""
    ship(rows.sparkSession).dataSource.register(BamSink)
    # What must not be there yet is checked by the commit; appending is the only other way that such a sink knows.
    rows.select("raw").write.format("bam").option("header", header.hex()).mode("overwrite" if mode == "overwrite" else "append").save(target)


def filter_bam(
    spark: SparkSession, source: str, target: str, barcodes: DataFrame, tag: str = "CB", split: int = bgzf.SPLIT, mode: str = "errorifexists",
    columns: tuple[str, ...] = ("place", "name", "chrom", "pos", "tags"),
) -> DataFrame:
    """Writes the records whose tag is one of the barcodes, in their order, with the header of ``source``; returns them as read back.

    A file has what is kept of one reading task: the upper bits of a row's id say which, so nothing is read to learn how rows are to be dealt.
    """
    from repliphase.sources.text_tables import tag_value

    wanted = barcodes.select(F.col(barcodes.columns[0]).alias("barcode")).distinct()
    files = bgzf.files(source)
    found = settled(index(spark, source, split))
    rows = read(spark, found=found, split=split, columns=["tags", "raw"]).select("raw", tag_value(F.col("tags"), tag).alias("barcode"), F.monotonically_increasing_id().alias("at"))
    kept = rows.join(wanted, "barcode", "left_semi").select("at", "raw")
    dealt = kept.repartitionById(max(1, _tasks(granules(found), split)), F.shiftright("at", 33).cast("int"))
    write(dealt.sortWithinPartitions("at"), target, Header(files[0][0]).raw, mode)
    return read(spark, target, columns=list(columns), split=split)
