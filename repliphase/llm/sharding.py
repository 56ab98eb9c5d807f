"""Sharding: best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Groups are rows with equal texts. Their exact sizes are counted in a histogram, whose classes the
driver packs; n of them need n * n / 2 bytes of input, so there are at most 250,000 in 30 GB. The
largest class goes first, each into the bin with the tightest remaining capacity, found in a
balanced tree; as many groups of a class as fit go at once, which is what packing them one after
the other gives. Groups are then numbered within their class and read their shard from the
class's row. For a given number of shards the least capacity is searched with sizes rounded to 12
significant bits, and then exact sizes are packed, with a little more room until they fit.

Defined cases: null text equals empty text; repeated rows are rows of one group; an empty table
gives no rows; a null id is an id; columns named like the five new ones are replaced, all others
stay. Groups larger than an equal share get a shard of their own and the rest is shared by the
other shards.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repliphase.llm import spark_tools as st


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key: tuple[int, int], rank: float):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, remove and the least entry with enough room."""

    def __init__(self, seed: int = 7):
        self._root, self._random = None, random.Random(seed)

    def _split(self, node, key):
        """Entries below the key, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, room: int, name: int) -> None:
        low, high = self._split(self._root, (room, name))
        self._root = self._merge(self._merge(low, _Node((room, name), self._random.random())), high)

    def remove(self, room: int, name: int) -> None:
        low, high = self._split(self._root, (room, name))
        _, high = self._split(high, (room, name + 1))
        self._root = self._merge(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self._root, None
        while node is not None:
            if node.key >= (size, -1):
                best, node = node.key, node.left
            else:
                node = node.right
        return best


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, bin, number of groups) in packing order; None if more than ``most`` bins are needed."""
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            raise ValueError("a group is larger than the capacity")
        while count:
            if (found := tree.tightest(size)) is None:
                if most is not None and bins >= most:
                    return None
                found = (capacity, bins)
                bins += 1
            else:
                tree.remove(*found)
            room, name = found
            some = min(count, room // size) if size else count
            runs.append((size, name, some))
            count -= some
            tree.insert(room - some * size, name)
    return runs


def _rounded(size: int) -> int:
    """A size rounded up to 12 significant bits."""
    unit = 1 << max(0, size.bit_length() - 12)
    return -(-size // unit) * unit


def pack_evenly(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs over at most ``shards`` bins of nearly the least capacity that packs all, within 1/1024.

    A group above an equal share of what is left has a bin of its own.
    """
    left, own, runs = sorted(classes), 0, []
    total = sum(s * n for s, n in left)
    while left and own < shards - 1 and left[-1][0] * (shards - own) > total:
        size, count = left[-1]
        runs.append((size, own, 1))
        own, total = own + 1, total - size
        left[-1:] = [(size, count - 1)] if count > 1 else []
    if not left:
        return runs
    free = shards - own
    rough = Counter()
    for size, count in left:
        rough[_rounded(size)] += count
    low = max(-(-total // free), left[-1][0])
    high, step = max(low, max(rough)), max(1, low // 4096)
    while best_fit_decreasing(rough.items(), high, free) is None:
        low, high = high, high + step
        step *= 2
    while high - low > max(1, high // 4096):
        middle = (low + high) // 2
        if middle < max(rough) or best_fit_decreasing(rough.items(), middle, free) is None:
            low = middle
        else:
            high = middle
    # Exact sizes are no larger; should their order still leave one over, a little more room takes it.
    while (found := best_fit_decreasing(left, high, free)) is None:
        high += max(1, high // 4096)
    return runs + [(size, own + name, count) for size, name, count in found]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, overhead: int = 16, capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` with shard and slot, and size, text_crc32 and their text's group.

    Without ``capacity``, exactly ``shards`` shards of near-equal bytes; with it, as few shards
    of that capacity as best-fit-decreasing needs. slot numbers each shard's rows from 0.
    Columns are prefixed: sh_size, sh_crc32, sh_group, sh_shard, sh_slot.
    """
    spark = docs.sparkSession
    docs = docs.drop("sh_size", "sh_crc32", "sh_group", "sh_shard", "sh_slot")
    key, times, one, whole, at, first, again = st.unused(docs.columns, "key", "times", "one", "whole", "at", "first", "again")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, group = (F.octet_length(text) + overhead).cast("long"), F.md5(text.cast("binary"))
    # Rows with equal id and text are told apart only at the end; until then they are one entry. Texts are read once for these.
    sized = docs.select(group.alias("sh_group"), F.xxhash64(id_col).alias(key), size.alias(one))
    entries = st.written(sized.groupBy("sh_group", key).agg(F.count("*").alias(times), F.first(one).alias(one)), "entries")
    groups = entries.groupBy("sh_group").agg(F.sum(F.col(times) * F.col(one)).alias(whole))
    classes = [tuple(r) for r in groups.groupBy(whole).count().collect()]  # bounded by the distinct sizes
    runs = best_fit_decreasing(classes, capacity) if capacity else pack_evenly(classes, shards)
    plan: dict[int, tuple[list[int], list[int]]] = {}
    for size_, name, count in runs:
        ends, names = plan.setdefault(size_, ([], []))
        ends.append((ends[-1] if ends else 0) + count)
        names.append(name)
    table = spark.createDataFrame([(size_, ends, names) for size_, (ends, names) in plan.items()], f"{whole} long, ends array<long>, names array<int>")
    groups = st.running(groups, [whole], ["sh_group"], None, at, 64).join(table, whole)
    placed = groups.select("sh_group", F.expr(f"names[size(filter(ends, e -> e <= {at}))]").alias("sh_shard"))
    entries = st.running(entries.join(placed, "sh_group"), ["sh_shard"], [key, "sh_group"], times, first, 64)
    # The only step that moves texts: one shuffle by id and text.
    rows = docs.withColumns({"sh_size": size, "sh_crc32": F.crc32(text), "sh_group": group, key: F.xxhash64(id_col)})
    copies = Window.partitionBy("sh_group", key).orderBy("sh_crc32")
    out = rows.withColumn(again, F.row_number().over(copies) - 1).join(entries.select("sh_group", key, "sh_shard", first), ["sh_group", key])
    return out.select(*docs.columns, "sh_size", "sh_crc32", "sh_group", "sh_shard", (F.col(first) + F.col(again)).alias("sh_slot"))
