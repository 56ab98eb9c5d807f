"""Foreground events: a mixture of two normals on log gaps, then weights and posteriors per cell."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repliphase.functions.storage import settled
from repliphase.operators import events as ev
from repliphase.session import ship


@dataclass(frozen=True)
class Mixture:
    mean1: float
    mean2: float
    sd1: float
    sd2: float
    weight: float


def _density(x: Column, mean: float, sd: float) -> Column:
    return F.exp(F.lit(-0.5) * F.pow((x - F.lit(float(mean))) / F.lit(float(sd)), 2)) / F.lit(float(sd))


def responsibility(x: Column, m: Mixture, weight: Column | None = None) -> Column:
    """The posterior of the short component at x."""
    w = F.lit(float(m.weight)) if weight is None else weight
    one, two = w * _density(x, m.mean1, m.sd1), (1 - w) * _density(x, m.mean2, m.sd2)
    return one / F.greatest(one + two, F.lit(1e-300))


def mixture_step(values: DataFrame, m: Mixture) -> DataFrame:
    """One row (n, n1, m1, m2, v1, v2) of the moments after one expectation step over (x, c), c counting equal x."""
    r = responsibility(F.col("x"), m)
    rows = values.select("x", "c", (r * F.col("c")).alias("a"), ((1 - r) * F.col("c")).alias("b"))
    s = rows.agg(
        F.sum("c").alias("n"), F.sum("a").alias("n1"), F.sum("b").alias("n2"),
        F.sum(F.col("a") * F.col("x")).alias("a1"), F.sum(F.col("b") * F.col("x")).alias("b1"),
        F.sum(F.col("a") * F.col("x") * F.col("x")).alias("a2"), F.sum(F.col("b") * F.col("x") * F.col("x")).alias("b2"),
    )
    m1, m2 = F.col("a1") / F.col("n1"), F.col("b1") / F.col("n2")
    return s.select("n", "n1", m1.alias("m1"), m2.alias("m2"), (F.col("a2") / F.col("n1") - m1 * m1).alias("v1"), (F.col("b2") / F.col("n2") - m2 * m2).alias("v2"))


#: How finely logs of gaps are told apart: a step of all gaps up to a million, and of at most a millionth beyond.
_FINE = 1_000_000


def _moments(x: np.ndarray, c: np.ndarray, m: Mixture) -> tuple[float, ...]:
    """(n1, m1, m2, v1, v2), as ``mixture_step`` has them."""
    one, two = (w * np.exp(-0.5 * ((x - mean) / sd) ** 2) / sd for w, mean, sd in ((m.weight, m.mean1, m.sd1), (1 - m.weight, m.mean2, m.sd2)))
    a = c * one / np.maximum(one + two, 1e-300)
    b = c - a
    n1, n2 = a.sum(), b.sum()
    m1, m2 = (w @ x / max(n, 1e-300) for w, n in ((a, n1), (b, n2)))
    return n1, m1, m2, a @ (x * x) / max(n1, 1e-300) - m1 * m1, b @ (x * x) / max(n2, 1e-300) - m2 * m2


def _fitted(x: np.ndarray, c: np.ndarray, m: Mixture, iterations: int, tolerance: float) -> Mixture:
    n = c.sum()
    for _ in range(iterations):
        n1, m1, m2, v1, v2 = _moments(x, c, m)
        if n1 < 5 or n - n1 < 5:
            break
        share = min(max(n1 / n, 0.02), 0.98)
        (a1, d1, w), (a2, d2, _) = sorted([(m1, max(math.sqrt(max(v1, 0.01)), 0.1), share), (m2, max(math.sqrt(max(v2, 0.01)), 0.1), 1 - share)], key=lambda p: p[0])
        old, m = m, Mixture(float(a1), float(a2), d1, d2, float(w))
        if max(abs(m.mean1 - old.mean1), abs(m.mean2 - old.mean2), abs(m.weight - old.weight)) < tolerance:
            break
    return m


def fit_mixture(gaps: DataFrame, iterations: int = 200, tolerance: float = 1e-7) -> Mixture | None:
    """The mixture of ln(gap), all gaps counted; None if there are too few or it does not separate.

    All steps run in one task of one job, over logs of gaps with their counts: every gap up to a million
    by itself, longer ones by the millionth of their logarithm. However many events there are, that
    is at most some millions of rows, and a genome's chromosomes bound it.
    """
    log = F.log(F.col("gap").cast("double"))
    counts = gaps.where("gap > 0").groupBy("gap").agg(F.count(F.lit(1)).alias("c")).withColumn("x", log)
    values = settled(counts.groupBy(F.round(F.col("x") * _FINE).alias("k")).agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("x"), F.sum("c").alias("c")).select("x", "c"))
    n, v = F.sum("c"), F.sum(F.col("c") * F.col("x") * F.col("x")) / F.sum("c") - F.pow(F.sum(F.col("c") * F.col("x")) / F.sum("c"), 2)
    q = values.agg(F.percentile("x", F.lit(0.25), F.col("c")).alias("q1"), F.percentile("x", F.lit(0.75), F.col("c")).alias("q3"), n.alias("n"), v.alias("v")).first()
    if not q.n or q.n < 50:
        return None
    spread = max(math.sqrt(max(q.v, 0.0)), 0.2)
    start = Mixture(q.q1, q.q3, max(0.6 * spread, 0.1), max(0.8 * spread, 0.1), 0.6)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), pa.schema([("x", pa.float64()), ("c", pa.int64())]))
        m = _fitted(found["x"].to_numpy(), found["c"].to_numpy().astype(float), start, iterations, tolerance)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in dataclasses.astuple(m)], names=[f.name for f in dataclasses.fields(m)])

    ship(gaps.sparkSession)
    row = values.repartition(1).mapInArrow(work, "mean1 double, mean2 double, sd1 double, sd2 double, weight double").first()
    m = Mixture(**row.asDict())
    return m if math.isfinite(sum(dataclasses.astuple(m))) and m.mean2 > m.mean1 else None


def cell_weights(gapped: DataFrame, m: Mixture, shrink: float = 60.0, iterations: int = 40) -> DataFrame:
    """Rows (cell, weight): each cell's share of short gaps, shrunk towards the pooled one, after a fixed number of steps.

    A cell's step needs all its gaps: each cell holds its distinct gaps with their counts in an
    array, and the steps run over that array without further shuffles.
    """
    by_gap = gapped.groupBy("cell", "gap").agg(F.count("*").alias("c"))
    x = F.log(F.col("gap").cast("double"))
    rows = by_gap.select("cell", F.struct(_density(x, m.mean1, m.sd1).alias("a"), _density(x, m.mean2, m.sd2).alias("b"), F.col("c").cast("double").alias("c")).alias("g"))
    held = rows.groupBy("cell").agg(F.sort_array(F.collect_list("g")).alias("g"), F.sum("g.c").alias("n"))

    def step(w: Column) -> Column:
        short = F.aggregate("g", F.lit(0.0), lambda s, g: s + g.c * (w * g.a) / F.greatest(w * g.a + (1 - w) * g.b, F.lit(1e-300)))
        blend = F.col("n") / (F.col("n") + F.lit(float(shrink)))
        return F.greatest(F.lit(0.01), F.least(F.lit(0.99), blend * short / F.col("n") + (1 - blend) * F.lit(float(m.weight))))

    weight = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.lit(float(m.weight)), lambda w, _: step(w))
    return held.select("cell", weight.alias("weight"))


def foreground(events: DataFrame, m: Mixture, threshold: float = 0.5, shrink: float = 60.0, min_events: int = 50, iterations: int = 40) -> DataFrame:
    """``events`` with gap, posterior and whether they are foreground.

    An event's posterior is the larger of those of the gaps on its two sides. A cell of at least
    ``min_events`` events keeps all of them if fewer than that would be foreground.
    """
    rows = ev.adjacent_gaps(events)
    weights = cell_weights(rows.where("gap is not null"), m, shrink, iterations)
    rows = rows.join(weights, "cell", "left")
    own = F.when(F.col("gap").isNotNull(), responsibility(F.log(F.col("gap").cast("double")), m, F.col("weight"))).otherwise(0.0)
    rows = rows.withColumn("_own", own)
    nxt = F.lead("_own").over(Window.partitionBy("cell", "h").orderBy("p", "seq"))
    rows = rows.withColumn("posterior", F.greatest("_own", F.coalesce(nxt, F.lit(0.0))))
    signal = F.col("posterior") > threshold
    kept = rows.groupBy("cell").agg(F.count_if(signal).alias("_s"), F.count("*").alias("_n")).select("cell", ((F.col("_s") < min_events) & (F.col("_n") >= min_events)).alias("_all"))
    return rows.join(kept, "cell").withColumn("foreground", signal | F.col("_all")).drop("_own", "_all", "weight")


def signal_fraction(marked: DataFrame) -> DataFrame:
    """Rows (cell, n_events, n_signal, frac_signal)."""
    out = marked.groupBy("cell").agg(F.count("*").alias("n_events"), F.count_if("foreground").alias("n_signal"))
    return out.withColumn("frac_signal", F.col("n_signal") / F.greatest("n_events", F.lit(1)))
