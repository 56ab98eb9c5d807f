"""Placing the remaining cells among ordered landmarks by smoothed local centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions import spectral
from repliphase.operators import similarity

FLOOR = 1e-6


def smoothed(cross: DataFrame, landmarks: DataFrame, half: int) -> DataFrame:
    """Rows (cell, landmark, t, phi, smooth): phi averaged over ``half`` landmarks on both sides, by t.

    ``cross`` has (cell, landmark, phi), ``landmarks`` (landmark, t). Missing phi are left out of
    the mean; there is a row for every landmark of each cell.
    """
    grid = cross.select("cell").distinct().crossJoin(F.broadcast(landmarks))  # a row per cell and landmark, as in cross
    rows = grid.join(cross, ["cell", "landmark"], "left")
    by = Window.partitionBy("cell").orderBy("t", "landmark").rowsBetween(-half, half)
    return rows.withColumn("smooth", F.avg("phi").over(by))


def centroids(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Rows (cell, centre): the mean t of the k largest values, weighted by value less the least of them."""
    by = Window.partitionBy("cell").orderBy(F.desc(F.round(value, 9)), "landmark")
    top = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(by)).where(f"_r <= {k}")
    weight = F.col(value) - F.min(value).over(Window.partitionBy("cell")) + FLOOR
    return top.withColumn("_w", weight).groupBy("cell").agg((F.sum(F.col("_w") * F.col("t")) / F.sum("_w")).alias("centre"))


def half_window(k: int, landmarks: int) -> int:
    return max(1, min(k // 3, max(1, landmarks // 20)))


def place(targets: DataFrame, landmarks: DataFrame, coords: DataFrame, replicates: DataFrame, block_of: DataFrame, k: int) -> DataFrame:
    """Rows (cell, hat, secondary, contrast, boot): where each target lies among the landmarks.

    ``targets`` and ``landmarks`` are occupancies, ``coords`` (cell, t), ``replicates``
    (rep, cell, coord). hat is the centroid over the smoothed similarities, secondary that over
    the plain ones; boot holds the hats under each replicate's coordinates, by replicate. Tasks that
    hold the packed landmarks pick each target's k nearest; their weighted means are plain sums.
    """
    coords = coords.where("t is not null")
    by_cell = {r.cell: r.t for r in coords.collect()}  # a row per landmark
    sent = similarity.send_landmarks(landmarks.join(coords, "cell", "left_semi"), block_of, by_cell)
    n = len(sent.value.cells)
    k = min(max(3, k), max(1, n - 1))
    half = half_window(k, n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for cells, side in held.tiles(batches):
            plain, smooth = spectral.Best(len(cells), k), spectral.Best(len(cells), k)
            total, known = np.zeros(len(cells)), np.zeros(len(cells))
            for lo in range(0, n, similarity.CHUNK):
                hi = min(n, lo + similarity.CHUNK)
                left, right = max(0, lo - half), min(n, hi + half)
                phi = held.against(cells, side, left, right)
                own = phi[:, lo - left : hi - left]
                total += np.where(np.isfinite(own), own, 0.0).sum(1)
                known += np.isfinite(own).sum(1)
                plain.add(own, lo)
                smooth.add(box_mean(phi, half)[:, lo - left : hi - left], lo)
            with np.errstate(divide="ignore", invalid="ignore"):
                contrast = np.where(plain.at >= 0, plain.value, 0.0).sum(1) / (plain.at >= 0).sum(1) - total / known
            if not n:
                plain.at = smooth.at = np.zeros((len(cells), 0), np.int64)
                plain.value = smooth.value = np.zeros((len(cells), 0))
            lists = [similarity._lists(held.cells[x.at], x.value, x.at >= 0, "landmark", "value") for x in (plain, smooth)]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(contrast, mask=np.isnan(contrast)), *lists], names=["cell", "contrast", "plain", "smooth"])

    kind = "array<struct<landmark:long,value:double>>"
    rows = sent.value.rows(targets).mapInArrow(work, f"cell long, contrast double, plain {kind}, smooth {kind}")
    reps = sorted(r.rep for r in replicates.select("rep").distinct().collect())
    at = replicates.groupBy(F.col("cell").alias("landmark")).pivot("rep", reps).agg(F.first("coord")) if reps else replicates.select(F.col("cell").alias("landmark")).limit(0)
    at = coords.select(F.col("cell").alias("landmark"), "t").join(at.withColumnsRenamed({str(r): f"t{r}" for r in reps}), "landmark", "left")

    def weighted(name: str):
        low = F.array_min(F.transform(name, lambda x: x.value)) - FLOOR
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("kind"), x.landmark.alias("landmark"), (x.value - low).alias("w")))

    near = rows.select("cell", "contrast", F.explode_outer(F.concat(weighted("plain"), weighted("smooth"))).alias("n")).select("cell", "contrast", "n.*")
    near = near.join(F.broadcast(at), "landmark", "left")  # a row per landmark, which send_landmarks has checked

    def mean(kind: str, t: str):
        use = F.when((F.col("kind") == kind) & F.col(t).isNotNull(), F.col("w"))
        return F.sum(use * F.col(t)) / F.sum(use)

    boot = F.array(*[mean("smooth", f"t{r}") for r in reps]).cast("array<double>")
    return near.groupBy("cell", "contrast").agg(mean("smooth", "t").alias("hat"), mean("plain", "t").alias("secondary"), boot.alias("boot")).select("cell", "hat", "secondary", "contrast", "boot")


def box_mean(values: np.ndarray, half: int) -> np.ndarray:
    """The mean of what is finite within ``half`` columns on both sides, as a sum of shifted rows; NaN where nothing is."""
    n, ok = values.shape[1], np.isfinite(values)
    total, count = np.zeros(values.shape), np.zeros(values.shape)
    plain = np.where(ok, values, 0.0)
    for shift in range(-min(half, n), min(half, n) + 1):
        to, of = slice(max(0, -shift), n - max(0, shift)), slice(max(0, shift), n - max(0, -shift))
        total[:, to] += plain[:, of]
        count[:, to] += ok[:, of]
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)
