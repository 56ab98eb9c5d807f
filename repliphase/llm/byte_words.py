"""Words of UTF-8 text as 64-bit hashes, for whole Arrow batches at a time.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D, with A-Z in lower case. As
UTF-8 uses bytes below 0x80 only for ASCII, this equals splitting by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTE[_LOWER]
_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        n = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about half a megabyte.

    Nulls are rows of no bytes. A row longer than that is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _CHUNK, "right")) - 1)
        last = min(last, n)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(raw)]
    begin[edges] = inside[edges]
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:-1] = inside[:-1] & ~inside[1:]
    stop[-1] = inside[-1]
    cut = edges[edges > 0]
    stop[cut] |= inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_STEP = np.random.default_rng(20240502).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _STEP[0]
    for k in range(1, width):
        total = total + words[k : k + n] * _STEP[k]
    return mix(total)


def row_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct window hashes of one row, sorted; a shorter row is one window of all its words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, width))


def rows_of_shingles(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row of a text column."""
    for first, raw, at in chunks(column):
        starts, ends, before = word_spans(raw, at)
        words = word_hashes(raw, starts, ends)
        full = windows(words, width) if len(words) >= width else np.zeros(0, np.uint64)
        for k in range(len(at) - 1):
            a, b = before[k], before[k + 1]
            if b - a >= width:
                found = full[a : b - width + 1].copy()
                found.sort()
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield first + k, found[keep]
            else:
                yield first + k, row_shingles(words[a:b], width)
