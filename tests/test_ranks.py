"""Ranks and quantiles over many range partitions, with long runs of ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from repliphase.functions import ranks, stats
from repliphase.operators import timing


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    return np.r_[np.full(900, 3.25), rng.integers(0, 50, 900) / 4, rng.standard_normal(900)].tolist()


@pytest.fixture(scope="module")
def table(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double").repartition(7).cache()


def test_numbers_and_totals(table, values):
    got = {r.k: (r.n, r.s) for r in ranks.running_total(ranks.numbered(table, ["v", "k"], "n"), ["v", "k"], "k", "s").collect()}
    order = sorted(range(len(values)), key=lambda k: (values[k], k))
    before = 0
    for n, k in enumerate(order):
        assert got[k] == (n + 1, before)
        before += k


def test_average_ranks(table, values):
    got = {r.k: r.r for r in ranks.average_ranks(table, "v", "r").collect()}
    v = np.array(values)
    assert got == {k: (v < x).sum() + ((v == x).sum() + 1) / 2 for k, x in enumerate(values)}


def test_quantiles(spark, table, values):
    asked = [0.0, 0.01, 0.25, 0.5, 0.777, 0.999, 1.0]
    assert list(ranks.quantiles(table, "v", asked).first()) == pytest.approx(np.quantile(values, asked).tolist(), abs=1e-12)
    assert list(stats.quantiles(table, "v", asked, few=True).first()) == pytest.approx(np.quantile(values, asked).tolist(), abs=1e-12)
    few = spark.createDataFrame([(2.0, 3), (None, 9), (1.0, 1)], "v double, w long")
    assert list(ranks.quantiles(few, "v", [0.0, 0.5, 1.0]).first()) == [1.0, 1.5, 2.0]
    assert list(ranks.quantiles(few, "v", [0.0, 1 / 3, 1.0], "w").first()) == [1.0, 2.0, 2.0]
    assert list(ranks.quantiles(few.limit(0), "v", [0.5]).first()) == [None]


def test_mad(spark, table, values):
    row = stats.robust_mad(table, "v").first()
    assert row.med == pytest.approx(np.median(values)) and row.scale == pytest.approx(1.4826 * np.median(np.abs(values - np.median(values))))
    assert stats.robust_mad(table.limit(0), "v").first() is None
    assert stats.robust_mad(table.limit(1), "v").first().scale == 1e-9


def test_order_and_tiles(table):
    rows = timing.tiles(timing.total_order(table, ["v", "k"]), "global_order", 7).collect()
    n = len(rows)
    assert sorted(r.global_order for r in rows) == list(range(1, n + 1))
    want = np.repeat(np.arange(1, 8), [n // 7 + (k < n % 7) for k in range(7)])
    assert all(r.pseudotime_bin == want[r.global_order - 1] and r.progression == (r.global_order - 0.5) / n for r in rows)
    few = timing.tiles(timing.total_order(table.limit(3), ["v", "k"]), "global_order", 5).collect()
    assert sorted(r.pseudotime_bin for r in few) == [1, 2, 3]


def test_no_task_sees_all_rows(table):
    """No sort or window of a row per partition's total but over range partitions."""
    plan = ranks.numbered(table, ["v", "k"], "n")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(_part#" in plan
    assert stats.unit_rank(table, ["v", "k"]).agg(F.max("rank01"), F.min("rank01")).first() == (1.0, 0.0)
