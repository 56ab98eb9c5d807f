"""Ordering landmarks, with block bootstrap and split halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.functions import spectral, stats
from repliphase.functions.storage import settled
from repliphase.operators import similarity

BASE, ODD, EVEN = -1, -2, -3


def block_weights(blocks: int, replicates: int, seed: int = 1) -> dict[int, list[float]]:
    """Weights by replicate: all ones, odd and even blocks, and multinomial resamples."""
    rng = np.random.default_rng(seed)
    out: dict[int, list[float]] = {BASE: [1.0] * blocks}
    if blocks >= 4:
        out[ODD] = [float(b % 2) for b in range(blocks)]
        out[EVEN] = [float(1 - b % 2) for b in range(blocks)]
    for r in range(replicates):
        out[r] = rng.multinomial(blocks, np.full(blocks, 1 / blocks)).astype(float).tolist()
    return out


def neighbour_count(landmarks: int, knn: int = 0) -> int:
    """``knn``, or if it is 0 a 25th of the landmarks within 10 and 50; fewer than the landmarks."""
    return min(knn or int(np.clip(landmarks // 25, 10, 50)), max(3, landmarks - 1))


#: Rows of similarities that a task holds, by block, while it weighs them for all replicates.
_ROWS = 32


def seriate_replicates(landmarks: DataFrame, block_of: DataFrame, k: int, replicates: int = 40, rounds: int = 2, seed: int = 1) -> DataFrame:
    """Rows (rep, cell, coord, score): the order of the landmarks under each replicate's block weights.

    Similarities by block are worked out once, some rows per task, and weighed for every replicate
    there. What leaves is a sketch of each row, its neighbours and a few of its similarities; a
    replicate's sketches, one per landmark, are put in order by one task. A replicate of fewer
    than two blocks gives no rows.
    """
    sent = similarity.send_landmarks(landmarks, block_of)
    weights = {r: w for r, w in block_weights(len(sent.value.slices), replicates, seed).items() if sum(x > 0 for x in w) >= 2 or r == BASE}
    names, n = np.array(list(weights), np.int32), len(sent.value.cells)
    table, k = np.array(list(weights.values())).reshape(len(names), -1), min(max(3, k), max(1, n - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, offsets = sent.value, spectral.Offsets(n)
        for cells, side in held.tiles(batches, _ROWS):
            row = np.searchsorted(held.cells, cells)
            other, counts = offsets.of(row)
            best = [spectral.Best(len(cells), k) for _ in names]
            across = np.full((len(names), *other.shape), np.nan)
            for lo in range(0, n, similarity.CHUNK):
                hi = min(n, lo + similarity.CHUNK)
                num, den = (np.stack(x).reshape(len(held.slices), -1).astype(np.float64) for x in zip(*side.weighed(held.side(slice(lo, hi)))))
                a, b = np.nonzero(counts & (other >= lo) & (other < hi))
                for r, w in enumerate(table):
                    phi = similarity._ratio((w @ num).reshape(len(cells), -1), (w @ den).reshape(len(cells), -1))
                    phi[cells[:, None] == held.cells[None, lo:hi]] = np.nan
                    best[r].add(phi, lo)
                    across[r, a, b] = phi[a, other[a, b] - lo]
            for r, rep in enumerate(names):
                near = best[r].at.astype(np.int32)
                arrays = [pa.array(np.full(len(cells), rep)), pa.array(row), pa.array(list(near), pa.list_(pa.int32())), pa.array(list(across[r]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["rep", "row", "near", "across"])

    def ordered(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        near, across = (np.array(rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), -1) for c in ("near", "across"))
        coord, score = spectral.seriate(near, across, spectral.Offsets(n), rounds)
        one = pa.array([score], pa.float64(), mask=np.isnan([score])).take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"rep": rows["rep"], "cell": sent.value.cells, "coord": pa.array(coord, mask=np.isnan(coord)), "score": one})

    sketches = sent.value.rows(landmarks).mapInArrow(work, "rep int, row long, near array<int>, across array<double>")
    return sketches.repartition(max(1, len(names)), "rep").groupBy("rep").applyInArrow(ordered, "rep int, cell long, coord double, score double")


def aligned_replicates(made: DataFrame, min_rho: float = 0.3, min_cover: float = 0.9) -> tuple[DataFrame, dict]:
    """Rows (rep, cell, coord) of accepted replicates, turned to the base order and ranked 0..1; and a summary.

    A replicate is accepted if it places enough of the base cells and correlates with them in rank, in
    either direction. Every replicate is judged and ranked by itself, side by side with the others.
    """
    base = made.where(F.col("rep") == BASE)
    met = made.where("rep >= 0").join(base.where("coord is not null").select("cell", F.col("coord").alias("at")), "cell")
    met = settled(met.where("coord is not null").select("rep", "cell", "coord", "at"))
    judged = rank_correlations(met, "rep", "coord", "at").crossJoin(base.agg(F.count("coord").alias("placed")))  # one row
    judged = judged.withColumn("ok", (F.col("n") >= min_cover * F.greatest("placed", F.lit(1))) & (F.abs("rho") >= min_rho))
    judged = settled(judged.select("rep", "rho", F.coalesce("ok", F.lit(False)).alias("ok")))
    turned = met.join(judged.where("ok"), "rep").withColumn("coord", F.signum("rho") * F.col("coord"))
    asked = made.where("rep >= 0").select("rep").distinct().count()
    seen = judged.agg(F.count_if("ok").alias("used"), F.percentile(F.when(F.col("ok"), F.abs("rho")), F.lit(0.5)).alias("median_rho")).first()  # a row per replicate
    _, split = halves(made)
    score = base.agg(F.max("score").alias("score")).first().score
    summary = {"failed": asked - seen.used, "used": seen.used, "median_rho": seen.median_rho, "split_rho": split, "robinson": score}
    return stats.unit_rank(turned, ["coord", "cell"], "place", ["rep"]).select("rep", "cell", F.col("place").alias("coord")), summary


def rank_correlations(rows: DataFrame, key: str, a: str, b: str, least: int = 5) -> DataFrame:
    """Rows (key, rho, n): the rank correlation within each key; NULL for fewer than ``least`` rows."""
    ranked = rows.select(key, stats.average_rank(a, [key]).alias("_a"), stats.average_rank(b, [key]).alias("_b"))
    n, size = F.count(F.lit(1)), F.stddev_pop("_a") * F.stddev_pop("_b")
    return ranked.groupBy(key).agg(F.when(n >= least, F.covar_pop("_a", "_b") / F.nullif(size, F.lit(0.0))).alias("rho"), n.alias("n"))


def halves(made: DataFrame) -> tuple[DataFrame, float | None]:
    """Rows (cell, order_odd_blocks, order_even_blocks), the even ones turned to run as the odd ones do; and their rank correlation."""
    both = made.where(F.col("rep").isin(ODD, EVEN)).groupBy("cell").agg(*[F.max(F.when(F.col("rep") == r, F.col("coord"))).alias(c) for r, c in ((ODD, "order_odd_blocks"), (EVEN, "order_even_blocks"))])
    both = settled(both)
    rho = rank_correlations(both.where("order_odd_blocks is not null and order_even_blocks is not null").withColumn("_one", F.lit(1)), "_one", "order_odd_blocks", "order_even_blocks").select("rho").first()
    rho = rho.rho if rho else None
    if rho is not None and rho < 0:
        both, rho = both.withColumn("order_even_blocks", 1 - F.col("order_even_blocks")), -rho
    return both, rho
