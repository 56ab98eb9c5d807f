"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in lower case, with every run of ASCII characters other than letters and
digits as one space. Each item is cut into segments of ``length`` bytes, each a quarter of that
further on (a shorter item is one segment). A document leaks an item when one of its segments
occurs in it with at most k edits, k being ``edit_percent`` of the segment's length.

By the q-gram lemma such an occurrence shares at least m + 1 - q(k + 1) of the segment's q-grams
on diagonals that differ by at most k. Hits are therefore counted in diagonal bands of 2(k + 1)
that overlap by half; bands that reach the bound are kept and verified by an alignment within
the band. Before that, stretches of a document where too few q-grams are known at all are
skipped by running sums, which loses nothing.

Items are the query set: they are read in blocks of about ``block_bytes``, each of which is
indexed on the driver, broadcast and run against all documents. One block is alive at a time: with
more than one, its findings are written before the next is read, at one scan of the documents a
block. ``leaks`` shuffles nothing. ``decontaminate`` filters rows in the same scan if there is one
block; with more it takes the leaking rows out by a join on id and text, which shuffles the texts once.

Defined cases: null, empty and too short texts (less than q bytes once normalised) leak nothing
and are leaked by nothing; rows that repeat an id are judged each by its own text; a null id is an
id; an empty table on either side gives no rows of ``leaks`` and takes none away. Columns other than
id and text are passed on unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.llm import spark_tools as st

_U = np.uint64
_CHUNK = 1 << 20
_CLASS = np.arange(256, dtype=np.uint8)
for _c in range(1, 128):
    if not chr(_c).isalnum():
        _CLASS[_c] = 32
_BITS = 22


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, a zero before, between and after, and where each begins (one more at the end)."""
    # A text's own zeros become spaces, so that a zero is always a border.
    joined = "\0".join(["", *[(t or "").lower().replace("\0", " ") for t in texts], ""])
    code = _CLASS[np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(code), bool)
    # One space of each run, none beside a border.
    keep[1:] = (code[1:] != 32) | ((code[:-1] != 32) & (code[:-1] != 0))
    code = code[keep]
    last = np.ones(len(code), bool)
    last[:-1] = (code[:-1] != 32) | (code[1:] != 0)
    code = code[last]
    return code, np.flatnonzero(code == 0) + 1


def _qgrams(code: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(code) - 7
    if n <= 0:
        return np.zeros(0, _U)
    code = np.ascontiguousarray(code)
    return np.ndarray((n,), "<u8", code, strides=(1,)).copy()


Q = 8


class Index:
    """The q-grams of a block of items by segment."""

    def __init__(self, ids: list[int], texts: list[str], length: int, edit_percent: float):
        code, begin = normalised(texts)
        self.items, segs, starts = ids, [], []
        for k in range(len(texts)):
            a, m = int(begin[k]), int(begin[k + 1] - begin[k] - 1)
            if m < Q:
                continue
            places = [0] if m <= length else sorted({*range(0, m - length + 1, length // 4), m - length})
            for p in places:
                segs.append((k, p, min(m, length)))
                starts.append(a + p)
        self.segs = np.array(segs, np.int64).reshape(-1, 3)
        size = self.segs[:, 2]
        self.edits = (size * edit_percent / 100).astype(np.int64)
        # Short segments get fewer edits where the lemma would otherwise ask for nothing.
        self.edits = np.minimum(self.edits, (size - Q) // Q)
        self.least = size + 1 - Q * (self.edits + 1)
        self.text = np.zeros((len(segs), max(1, int(size.max()) if len(segs) else 1)), np.uint8)
        grams, of, at = [], [], []
        for s, a in enumerate(starts):
            m = int(size[s])
            self.text[s, :m] = code[a : a + m]
            g = _qgrams(code[a : a + m])
            grams.append(g)
            of.append(np.full(len(g), s))
            at.append(np.arange(len(g)))
        grams = np.concatenate(grams) if grams else np.zeros(0, _U)
        by = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[by], return_index=True)
        self.first = np.append(first, len(grams)).astype(np.int32)
        self.of, self.at = (np.concatenate(x)[by].astype(np.int32) if x else np.zeros(0, np.int32) for x in (of, at))
        self.known = np.zeros(1 << _BITS, bool)
        self.known[self._cell(self.grams)] = True

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return ((grams * _U(0x9E3779B97F4A7C15)) >> _U(64 - _BITS)).astype(np.int64)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, segment, start, stop, edits) for each segment found in a text; one per band that holds it."""
        code, begin = normalised(texts)
        grams = _qgrams(code)
        if not len(grams) or not len(self.segs):
            return []
        member = self.known[self._cell(grams)]
        reach, least = int((self.segs[:, 2] + self.edits).max()) - Q + 1, int(self.least.min())
        sums = np.concatenate([[0], np.cumsum(member)])
        lo = np.arange(len(grams))
        hi = np.minimum(lo + reach, len(grams))
        full = sums[hi] - sums[lo] >= least
        mark = np.zeros(len(grams) + 1, np.int32)
        np.add.at(mark, lo[full], 1)
        np.add.at(mark, hi[full], -1)
        places = np.flatnonzero(member & (np.cumsum(mark[:-1]) > 0))
        if not len(places):
            return []
        slot = np.minimum(np.searchsorted(self.grams, grams[places]), len(self.grams) - 1)
        hit = self.grams[slot] == grams[places]
        places, slot = places[hit], slot[hit]
        found = []
        # Hits are expanded in bounded runs that end at the border of a text.
        times = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        owner = np.searchsorted(begin, places, "right") - 1
        ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) + 1
        run, total = 0, np.concatenate([[0], np.cumsum(times)])
        while run < len(places):
            stop = int(ends[max(np.searchsorted(total[ends], total[run] + (1 << 21), "right") - 1, np.searchsorted(ends, run + 1))])
            found += self._bands(code, begin, places[run:stop], slot[run:stop], times[run:stop], owner[run:stop])
            run = stop
        return found

    def _bands(self, code, begin, places, slot, times, owner) -> list[tuple[int, int, int, int, int]]:
        base = np.repeat(np.cumsum(times) - times, times)
        entry = np.arange(int(times.sum())) - base + np.repeat(self.first[slot], times)
        seg, text = self.of[entry].astype(np.int64), np.repeat(owner, times)
        diagonal = np.repeat(places, times) - self.at[entry]
        step = self.edits[seg] + 1
        band = diagonal // step
        # Band b holds the diagonals from b*step to (b + 2)*step; each diagonal lies in two bands.
        low, high = int(band.min()) - 1, int(band.max()) + 1
        width = high - low + 1
        key = (text * len(self.segs) + seg) * width + (band - low)
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        pair, at = keys // width, keys % width + low
        seg, text = pair % len(self.segs), pair // len(self.segs)
        keep = counts >= self.least[seg]
        if not keep.any():
            return []
        seg, text, start = seg[keep], text[keep], at[keep] * (self.edits[seg[keep]] + 1)
        out = []
        for k in range(0, len(seg), 512):
            part = slice(k, k + 512)
            edits, stop = self._align(code, seg[part], start[part])
            good = edits <= self.edits[seg[part]]
            for t, s, e, z in zip(text[part][good], seg[part][good], edits[good], stop[good]):
                out.append((int(t), int(s), int(z - self.segs[s, 2] - begin[t]), int(z - begin[t]), int(e)))
        return out

    def _align(self, code: np.ndarray, seg: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment within its band of the text, and where that alignment ends."""
        k, size = self.edits[seg], self.segs[seg, 2]
        wide = int((2 * (k + 1) + 2 * k).max())
        longest = int(size.max())
        place = (start - k)[:, None] + np.arange(wide + longest)[None, :]
        text = np.where((place >= 0) & (place < len(code)), code[np.clip(place, 0, len(code) - 1)], 0)
        inside = np.arange(wide)[None, :] < (2 * (k + 1) + 2 * k)[:, None]
        far = np.int64(1 << 20)
        row = np.where(inside, 0, far)
        ramp = np.arange(wide)
        best, end = np.full(len(seg), far), np.zeros(len(seg), np.int64)
        for i in range(longest):
            same = text[:, i : i + wide] == self.text[seg, i][:, None]
            skip = np.concatenate([row[:, 1:], np.full((len(seg), 1), far)], 1) + 1
            row = np.minimum(row + ~same, skip)
            row = np.minimum.accumulate(row - ramp, 1) + ramp
            row = np.where(inside, row, far)
            if (done := size == i + 1).any():
                best[done] = row[done].min(1)
                end[done] = (start - k)[done] + i + 1 + row[done].argmin(1)
        return best, end


def _hits(index: Index, texts: list[str | None]) -> dict[tuple[int, int], dict[int, tuple[int, int, int]]]:
    """By row and item number the best (start, stop, edits) of each segment found, by its place in the item."""
    sizes = np.cumsum([len(t or "") for t in texts])
    rows, first = {}, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + _CHUNK, "right")))
        for t, s, a, z, e in index.search(texts[first:last]):
            item, place = int(index.segs[s, 0]), int(index.segs[s, 1])
            hits = rows.setdefault((first + t, item), {})
            if place not in hits or e < hits[place][2]:
                hits[place] = (a, z, e)
        first = last
    return rows


def _found(index):
    """Rows (doc_id, ..., text) to one row (doc_id, ..., findings) per document and leaked item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Index = index.value
        total = np.bincount(made.segs[:, 0], minlength=len(made.items)) if len(made.segs) else []
        for batch in batches:
            rows = _hits(made, batch.column(batch.num_columns - 1).to_pylist())
            order = sorted(rows)
            docs = pa.array([d for d, _ in order], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(docs) for c in batch.columns[:-1]],
                    pa.array([made.items[i] for _, i in order], pa.int64()),
                    pa.array([len(rows[x]) for x in order], pa.int32()),
                    pa.array([int(total[i]) for _, i in order], pa.int32()),
                    pa.array([min(h[2] for h in rows[x].values()) for x in order], pa.int32()),
                    pa.array([[{"item_start": p, "start": h[0], "stop": h[1], "edits": h[2]} for p, h in sorted(rows[x].items())] for x in order], _SPANS),
                ],
                names=[*batch.schema.names[:-1], "item_id", "segments", "of_segments", "least_edits", "spans"],
            )

    return work


def _without_leaks(index):
    """The rows, without their last column, in which no item is found; that column is their text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[d for d, _ in _hits(index.value, batch.column(batch.num_columns - 1).to_pylist())]] = False
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep))

    return work


_SPANS = pa.list_(pa.struct([("item_start", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
_FOUND = "item_id long, segments int, of_segments int, least_edits int, spans array<struct<item_start:int,start:int,stop:int,edits:int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, length: int = 80, edit_percent: float = 7.5, block_bytes: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, item_id, segments, of_segments, least_edits, spans): one per document and leaked item.

    spans are (item_start, start, stop, edits) in the normalised texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _search(rows, _blocks(benchmark, item_col, item_text_col, block_bytes), length, edit_percent)


def _search(rows: DataFrame, blocks: list, length: int, edit_percent: float) -> DataFrame:
    """The findings in rows (doc_id, ..., text) of each block of items, one block after the other."""
    spark, schema = rows.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", " + _FOUND
    out = spark.createDataFrame([], schema)
    for items in blocks:
        index = spark.sparkContext.broadcast(Index(*_texts(items), length, edit_percent))
        part = rows.mapInArrow(_found(index), schema)
        if len(blocks) == 1:
            return part
        out = out.union(st.written(part, "leaks"))
        index.destroy()
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[DataFrame]:
    """The items in blocks of about ``most`` bytes, in the order of their ids; the driver sees the sizes of blocks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0]
    if not size:
        return []
    if size <= most:
        return [items]
    ranges = int(-(-size // most))
    # Dealt by a hash of id and text, which makes blocks of near-equal size unless an item is larger than a block.
    items = st.written(items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(ranges)).cast("int")), "items", by="b")
    return [items.where(F.col("b") == b) for b in range(ranges)]


def _texts(items: DataFrame) -> tuple[list, list]:
    rows = sorted(((r.i is not None, r.i or 0, r.t, r.i) for r in items.select("i", "t").collect()), key=lambda r: r[:3])  # a block of items
    return [r[3] for r in rows], [r[2] for r in rows]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, length: int = 80, edit_percent: float = 7.5, block_bytes: int = 1 << 20,
) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    blocks, text = _blocks(benchmark, item_col, item_text_col, block_bytes), F.col(text_col).cast("string")
    if not blocks:
        return docs
    key, one, two, said = st.unused([*docs.columns, "doc_id"], "key", "one", "two", "text")
    if len(blocks) == 1:
        index = docs.sparkSession.sparkContext.broadcast(Index(*_texts(blocks[0]), length, edit_percent))
        return docs.withColumn(said, text).mapInArrow(_without_leaks(index), docs.schema)
    prints = [F.xxhash64(text).alias(one), F.xxhash64(F.reverse(text)).alias(two)]
    found = _search(docs.select(F.col(id_col).alias("doc_id"), *prints, text.alias("text")), blocks, length, edit_percent)
    found = found.select(F.col("doc_id").alias(key), one, two).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(one)) & (F.xxhash64(F.reverse(text)) == F.col(two)), "left_anti")
