"""Block-gzipped files: their blocks, and texts in them read in pieces.

A block-gzipped file is a run of gzip members of at most 64 KiB, each with its own size in its
header, so that a task can begin at any of them. A place in such a file is a long: the offset of the
block in the upper bits and, in the lower 16, the offset in the block's bytes. Paths are files,
patterns of local files, folders, or URIs that Arrow's file systems open (``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import glob
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from repliphase.session import ship

#: Fixed value of the format: the empty block that ends a file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
# Fixed values of the format: how a block begins, up to the field that holds its size.
_BLOCK = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00", re.DOTALL)
_CHUNK = 1 << 18
SPLIT = 64 << 20


def files(path: str) -> list[tuple[str, int]]:
    """The files of a path with their sizes, in order of name; names that begin with ``_`` or ``.`` are no data."""
    from pyarrow import fs

    system, names = fs.LocalFileSystem(), sorted(glob.glob(path))
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(_uri(path))
        head = path[: len(path) - len(inner)] if path.endswith(inner) else path.rstrip("/")[: -len(inner.rstrip("/"))]
        names = [inner]
    else:
        head = ""
    found = []
    for name in names:
        info = system.get_file_info(name)
        inside = system.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
        found += [(head + x.path, x.size) for x in inside if x.type == fs.FileType.File and x.base_name[0] not in "_."]
    if not found:
        raise ValueError(f"{path} has no files")
    return sorted(found)


def _uri(path: str) -> str:
    """``file:/x`` as ``file:///x``; other URIs as they are."""
    return re.sub(r"^file:/+", "file:///", path)


def opened(path: str):
    """The file, open for reading."""
    from pyarrow import fs

    if ":/" not in path:
        return open(path, "rb")  # noqa: SIM115
    system, inner = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(inner)


def is_bgzf(path: str) -> bool:
    with opened(path) as file:
        return bool(_BLOCK.match(file.read(18)))


def blocks(path: str, start: int, exact: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, bytes) of the blocks that hold any bytes, from the first that begins at ``start`` or later.

    ``exact`` says that one begins right there. Elsewhere the first is where a block's size leads to
    another block or to the end of the file.
    """
    with opened(path) as file:
        file.seek(start)
        held, base, found = b"", start, exact or start == 0
        while not found:
            more = file.read(_CHUNK)
            held += more
            for match in _BLOCK.finditer(held):
                at = match.start()
                after = at + struct.unpack_from("<H", held, at + 16)[0] + 1 if at + 18 <= len(held) else len(held) + 1
                if _BLOCK.match(held, after) or (not more and after == len(held)):
                    held, base, found = held[at:], base + at, True
                    break
            if not found:
                if not more:
                    return
                keep = min(len(held), 1 << 17)  # a block and the beginning of the next
                held, base = held[-keep:], base + len(held) - keep
        while True:
            while len(held) < 18 or len(held) < struct.unpack_from("<H", held, 16)[0] + 1:
                if not (more := file.read(_CHUNK)):
                    return
                held += more
            size = struct.unpack_from("<H", held, 16)[0] + 1
            if out := zlib.decompress(held[:size], 31):
                yield base, out
            held, base = held[size:], base + size


class Window:
    """A moving stretch of a file's bytes, with the place in the file of each."""

    def __init__(self, path: str, start: int, exact: bool = False):
        self._blocks = blocks(path, start, exact)
        self.data, self._marks, self.ended = bytearray(), [], False

    def grow(self) -> bool:
        """Takes one more block; false if there is none."""
        block = None if self.ended else next(self._blocks, None)
        if block is None:
            self.ended = True
            return False
        self._marks.append((len(self.data), block[0]))
        self.data += block[1]
        return True

    def reach(self, size: int) -> bool:
        """Whether there are so many bytes, after taking what is needed."""
        while len(self.data) < size:
            if not self.grow():
                return False
        return True

    def fill(self, size: int, stop: int) -> int:
        """Takes blocks until there are so many bytes or one begins at ``stop`` or later; where the bytes of the blocks before that end."""
        while (not self._marks or self._marks[-1][1] < stop) and len(self.data) < size and self.grow():
            pass
        return next((at for at, block in self._marks if block >= stop), len(self.data))

    def places(self, at: np.ndarray) -> np.ndarray:
        """The places in the file of these bytes."""
        begin, block = np.array(self._marks, np.int64).reshape(-1, 2).T
        k = np.searchsorted(begin, at, "right") - 1
        return block[k] << 16 | at - begin[k]

    def offset(self, at: int) -> tuple[int, int]:
        """(offset of the block, offset in it) of a byte that is held."""
        k = len(self._marks) - 1
        while self._marks[k][0] > at:
            k -= 1
        return self._marks[k][1], at - self._marks[k][0]

    def drop(self, at: int) -> int:
        """Lets go of whole blocks before byte ``at``; returns its new place."""
        k = 0
        while k + 1 < len(self._marks) and self._marks[k + 1][0] <= at:
            k += 1
        cut = self._marks[k][0] if self._marks else 0
        if cut:
            del self.data[:cut]
            self._marks = [(b - cut, o) for b, o in self._marks[k:]]
        return at - cut


def pieces(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Rows (file, size, piece, start, stop): each file cut into stretches of ``split`` bytes, one a task, in order."""
    rows = spark.createDataFrame([(k, *f) for k, f in enumerate(files(path))], "number int, file string, size long")
    rows = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (size - 1) div {split}))")))
    return rows.selectExpr("number", "file", "size", "piece", f"piece * {split} as start", f"least(size, (piece + 1) * {split}) as stop")


def in_order(rows: DataFrame, tasks: int, *order: str) -> DataFrame:
    """The rows dealt over tasks as they follow one another."""
    return rows.repartitionByRange(max(1, tasks), *order).sortWithinPartitions(*order)


def _lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The lines that begin after the first byte of ``start`` and not after that of ``stop``; the first line belongs to the file's start."""
    window = Window(path, start)
    at, begun = 0, start == 0
    while True:
        end = window.data.find(b"\n", at)
        while end < 0:
            seen = len(window.data)
            if not begun and seen and window.offset(seen - 1)[0] >= stop:
                return
            if not window.grow():
                break
            end = window.data.find(b"\n", seen)
        if end < 0:
            if begun and at < len(window.data):
                yield bytes(window.data[at:])
            return
        if begun:
            yield bytes(window.data[at:end])
        begun = True
        if window.offset(end)[0] >= stop:
            return
        at = window.drop(end + 1) if end - at > _CHUNK or end > 1 << 20 else end + 1


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Rows (value) of block-gzipped texts, as Spark's text reader gives them, but with a task for every ``split`` bytes of a file.

    Rows keep their order: ids that rise with the row rise along a file, and from file to file.
    """
    ship(spark)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for file, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held, size = [], 0
                for line in _lines(file, start, stop):
                    parts = line.split(b"\r") if b"\r" in line else [line]
                    held += parts[:-1] if len(parts) > 1 and not parts[-1] else parts
                    size += len(line)
                    if size > 1 << 22 or len(held) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    rows = pieces(spark, path, split)
    rows = in_order(rows, rows.count(), "number", "piece")
    return rows.select("file", "start", "stop").mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))


def compressed(raw: bytes, level: int = 6) -> bytes:
    """The bytes as blocks, without the closing empty one."""
    out = []
    for k in range(0, len(raw), 0xFF00):
        part = raw[k : k + 0xFF00]
        deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _joined(values) -> bytes:
    """The bytes of binary values, one after the other."""
    import pyarrow.compute as pc

    values = pc.fill_null(values, b"")
    if not len(values):
        return b""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return bytes(memoryview(values.buffers()[2])[ends[0] : ends[-1]]) if values.buffers()[2] else b""


class _Wrote(WriterCommitMessage):
    def __init__(self, name: str | None, n: int):
        self.name, self.n = name, n


class Writer(DataSourceArrowWriter):
    """Each task writes a file aside; the commit moves what the successful tasks wrote to the target. Of a failed job no
    file is moved, so readers see none; a task that is killed while the job is undone may leave one aside.

    A file has the header, the values of one column, each with an ending, and the closing block.
    """

    def __init__(self, target: str, overwrite: bool, column: str, header: bytes, ending: bytes, suffix: str):
        self.target, self.overwrite, self.aside = target.rstrip("/"), overwrite, f"_aside-{uuid.uuid4().hex}"
        self.column, self.header, self.ending, self.suffix = column, header, ending, suffix

    def _system(self):
        from pyarrow import fs

        if ":/" in self.target:
            return fs.FileSystem.from_uri(_uri(self.target))
        return fs.LocalFileSystem(), self.target

    def write(self, iterator) -> WriterCommitMessage:
        import pyarrow as pa
        from pyspark import TaskContext

        system, target = self._system()
        name, n, held, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.suffix}", 0, [self.header], len(self.header)
        system.create_dir(f"{target}/{self.aside}")
        try:
            with system.open_output_stream(f"{target}/{self.aside}/{name}", compression=None) as out:
                for batch in iterator:
                    values = batch.column(batch.schema.get_field_index(self.column)).cast(pa.binary())
                    # With no ending between them values go out as they lie in memory.
                    whole = [_joined(values)] if not self.ending else values.to_pylist()
                    n += len(values) - len(whole)
                    for value in whole:
                        held.append((value or b"") + self.ending)
                        size += len(held[-1])
                        n += 1
                        if size > 1 << 22:
                            out.write(compressed(b"".join(held)))
                            held, size = [], 0
                out.write(compressed(b"".join(held)) + EOF_BLOCK)
        except BaseException:
            system.delete_file(f"{target}/{self.aside}/{name}")
            raise
        return _Wrote(name, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, target = self._system()
        system.create_dir(target)
        old = [x for x in system.get_file_info(fs.FileSelector(target)) if x.type == fs.FileType.File and x.base_name.startswith("part-")]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{target} holds files already")
        done = [m for m in messages if m is not None]
        # A file without records is of no use, but one is kept so that the folder has a header.
        named = [m for m in done if m.n] or done[:1]
        for m in named:
            system.move(f"{target}/{self.aside}/{m.name}", f"{target}/{m.name}")
        for x in old:
            system.delete_file(x.path)
        self._drop()
        with system.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        system, target = self._system()
        if system.get_file_info(f"{target}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{target}/{self.aside}")


class BgzfSink(DataSource):
    """Writes rows with a column value as block-gzipped lines. Option: path, a folder."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], overwrite, "value", b"", b"\n", ".gz")


def write_lines(rows: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Writes rows (value) as a folder of block-gzipped texts, in the order of the rows."""
    ship(rows.sparkSession).dataSource.register(BgzfSink)
    rows.select("value").write.format("bgzf").mode("overwrite" if mode == "overwrite" else "append").save(target)
