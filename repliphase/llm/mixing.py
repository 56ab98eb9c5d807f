"""Mixing sources to target weights.

Each source is one stream of words, its documents in a fixed pseudorandom order, packed into
blocks of a fixed number of words. For each output shard the driver draws multinomial counts of
slots per source, in proportion to what each source still lacks; a source's slots are mapped
through pseudorandom permutations of its block numbers, a new one for each round through the
source, and joined with the blocks by number.

Defined cases: a null source is a source of its own, last in order; null, empty and wordless
texts have size 0 and are never drawn; repeated rows are documents of their own; an empty table
gives no rows. The last block of a source may be short. Sources are collected on the driver, one
row each, and may number at most ``most_sources``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.llm import byte_words as bw
from repliphase.llm import spark_tools as st

_U = np.uint64


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight; none above cap times its size, the excess going to the others by weight."""
    out, left, budget = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while left:
        whole = sum(weights[k] for k in left)
        over = [k for k in left if budget * weights[k] / whole > cap * sizes[k]]
        if not over:
            for k in left:
                out[k] = budget * weights[k] / whole
            break
        for k in over:
            out[k] = float(cap * sizes[k])
        budget -= sum(out[k] for k in over)
        left = [k for k in left if k not in set(over)]
    return out


def draw(wanted: np.ndarray, most: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots per (shard, source): multinomial draws by what is still wanted, none above ``most`` in all."""
    rng, taken = np.random.default_rng(seed), np.zeros(len(wanted), np.int64)
    total, out = int(round(wanted.sum())), np.zeros((shards, len(wanted)), np.int64)
    for s in range(shards):
        left = total * (s + 1) // shards - total * s // shards
        while left:
            lack = np.where(taken < most, np.maximum(wanted - taken, 0), 0)
            if not lack.sum() > 0:
                lack = (most - taken).astype(float)
            if not lack.sum() > 0:
                break
            got = np.minimum(rng.multinomial(left, lack / lack.sum()), most - taken)
            taken += got
            out[s] += got
            left -= int(got.sum())
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1 applied to each index.

    A four-round Feistel network over the next even power of two, walked until it falls inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(_U)
    mask = (_U(1) << half) - _U(1)
    value, key = index.astype(_U), key.astype(_U)
    todo = np.arange(len(value))
    while len(todo):
        x, h, m, k = value[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (bw.mix(right + bw.mix(k + _U((r + 1) * 0x9E3779B97F4A7C15 % 2**64))) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo].astype(_U)]
    return value.astype(np.int64)


def _slots(seed: int):
    """Rows (shard, src, first, count, blocks) to one row (shard, src, slot, block) per slot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, src, first, count, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                slot = np.arange(first, first + count)
                key = _U(seed) + bw.mix(np.full(count, src + 1, _U)) + bw.mix((slot // blocks).astype(_U) + _U(77))
                block = permuted(slot % blocks, np.full(count, blocks), key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, shard), pa.int32()), pa.array(np.full(count, src), pa.int32()), pa.array(slot), pa.array(block)], names=["shard", "src", "slot", "block"])

    return work


class Mix:
    """The plan and the parts of one mix: ``sources``, ``placed`` and ``pieces``.

    sources: rows (src, source, source_size, target). placed: rows (doc_id, size, src, start),
    one per document with its place in its source's stream. pieces: rows (shard, slot, src,
    block, start, from_word, to_word): which words of the document at ``start`` a slot takes.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, block: int = 128, shards: int = 40, seed: int = 20240601, most_sources: int = 1_000_000):
        spark = docs.sparkSession
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(st.WORD)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("print"))
        base = st.written(base, "sizes")  # the texts are read once
        sizes = base.groupBy("source").agg(F.sum("size").alias("n"))
        found = sizes.limit(most_sources + 1).collect()
        if len(found) > most_sources:
            raise ValueError(f"more than {most_sources} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        n = [r.n for r in found]
        wanted = targets(n, [weights[k % len(weights)] for k in range(len(n))], share * sum(n), cap)
        self.sources = spark.createDataFrame([(k, r.source, r.n, wanted[k]) for k, r in enumerate(found)], "src int, source string, source_size long, target double")
        named = self.sources.select("src", F.col("source").alias("_source"))
        base = base.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
        self.placed = st.written(st.running(base, ["src"], ["doc_id", "print"], "size", "start", 256), "placed")

        blocks = np.array([-(-x // block) for x in n], np.int64)
        each = np.array(n, float) / np.maximum(blocks, 1)
        drawn = draw(np.array(wanted) / np.maximum(each, 1), cap * blocks, shards, seed) if sum(n) else np.zeros((0, len(n)), np.int64)
        rows, first = [], np.zeros(len(n), np.int64)
        for s in range(len(drawn)):
            for k in range(len(n)):
                for at in range(0, int(drawn[s, k]), 1 << 16):
                    rows.append((s, k, int(first[k]) + at, min(1 << 16, int(drawn[s, k]) - at), int(blocks[k])))
                first[k] += drawn[s, k]
        plan = spark.createDataFrame(rows, "shard int, src int, first long, count long, blocks long")
        tasks = max(1, min(len(rows), max(200, int(drawn.sum()) >> 20)))
        slots = plan.repartition(tasks).mapInArrow(_slots(seed), "shard int, src int, slot long, block long")
        whole = self.placed.where("size > 0").select("src", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
        whole = whole.selectExpr("src", "start", "block", f"greatest(0, block * {block} - start) as from_word", f"least(size, (block + 1) * {block} - start) as to_word")
        # Both sides grow with the input, though the plan that the slots come from looks small.
        self.pieces = slots.hint("merge").join(whole, ["src", "block"])

    def taken(self) -> DataFrame:
        """Rows (doc_id, size, source_size, target, taken, source): one per document."""
        sums = self.pieces.groupBy("src", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
        rows = self.placed.alias("d").join(sums.alias("t"), F.expr("d.src = t.src and d.start = t.start and d.size > 0"), "left").select("d.*", "taken")
        return rows.join(self.sources, "src").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

    def rounds(self) -> DataFrame:
        """Rows (doc_id, print, size, src, round, spans): the words of a document that each round takes, merged and in order."""
        times = self.pieces.groupBy("src", "start", "from_word", "to_word").agg(F.count("*").alias("times"))
        times = times.select("src", "start", "from_word", "to_word", F.explode(F.expr("sequence(1, cast(times as int))")).alias("round"))
        spans = times.groupBy("src", "start", "round").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))
        return self.placed.where("size > 0").join(spans, ["src", "start"]).select("doc_id", "print", "size", "src", "round", "spans")

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """The mix as rows of ``docs``: one per document and round that takes words of it, with only those words.

        Neighbouring spans stay as they stand in the text, other gaps become a line end.
        """
        print_of = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
        others = [c for c in docs.columns if c not in (id_col, source_col)]
        # Rows that repeat id and text have a place each in the streams, so here they count once.
        # Texts move once: grouping and join have the same keys.
        rows = docs.groupBy(print_of.alias("__print"), F.xxhash64(id_col).alias("__key")).agg(F.first(id_col).alias("__id"), *[F.first(c).alias(c) for c in others])
        taken = self.rounds().join(self.sources.select("src", F.col("source").alias("__source")), "src")
        taken = taken.select(F.col("print").alias("__print"), F.xxhash64("doc_id").alias("__key"), "__source", F.col("spans").alias("__spans"))
        made = rows.join(taken, ["__print", "__key"])
        cut = made.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), *[c for c in others if c != text_col], F.col(text_col).alias("__text"), "__spans")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-2]) + f", `{text_col}` string"
        return cut.mapInArrow(_cut(text_col), schema).select(*docs.columns)


def _cut(text_col: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 2), [""] * len(batch)
            spans = batch.column(batch.num_columns - 1).to_pylist()
            for first, raw, at in bw.chunks(texts):
                starts, ends, before = bw.word_spans(raw, at)
                for k in range(len(at) - 1):
                    parts, begin, stop = [], None, None
                    for x in [*spans[first + k], None]:
                        if x is not None and x["from_word"] == stop:
                            stop = x["to_word"]
                            continue
                        if stop is not None:
                            # The first and last words of a text bring the white space around it.
                            a = at[k] if begin == 0 else starts[before[k] + begin]
                            z = at[k + 1] if before[k] + stop == before[k + 1] else ends[before[k] + stop - 1]
                            parts.append(raw[a:z].tobytes())
                        if x is not None:
                            begin, stop = x["from_word"], x["to_word"]
                    out[first + k] = b"\n".join(parts).decode()
            names = [*batch.schema.names[:-2], text_col]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=names)

    return work
