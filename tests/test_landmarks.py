"""The landmark queries run over the whole job of a run's defaults."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from repliphase.config import Config
from repliphase.functions import spectral
from repliphase.operators import extension, seriation, similarity
from repliphase.plans import catalogue, standin

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
CELLS = 300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose events have a planted order: the cells of ``Tables.planted`` as users."""
    if not DATA.exists():
        pytest.skip("no test tables")
    out = tmp_path_factory.mktemp("cells")
    planted = standin.Tables(spark, f"{DATA}/sf0.1").planted().where(f"cell < {CELLS}")
    day = F.expr("timestampadd(SECOND, p, timestamp_ntz'2024-01-01 00:00:00')")
    kind = F.element_at(F.array(*map(F.lit, standin.NAMES)), F.col("h") + 1)
    planted.select(F.col("seq").alias("event_id"), day.alias("ts"), F.col("cell").alias("user_id"), kind.alias("event_type"), "value").write.parquet(f"{out}/events.parquet")
    spark.read.parquet(f"{DATA}/sf0.1/supplier.parquet").write.parquet(f"{out}/supplier.parquet")
    return str(out)


@pytest.fixture(scope="module")
def made(spark, folder):
    return catalogue.QUERIES["landmark_seriation"](spark, folder).toPandas()


def test_every_cell_is_ordered_in_every_replicate(spark, folder, made):
    cells = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct().count()
    assert cells == CELLS and made["cell"].nunique() == cells
    assert set(made["rep"]) == {seriation.BASE, seriation.ODD, seriation.EVEN, *range(Config().n_bootstrap)}
    assert len(made) == cells * (Config().n_bootstrap + 3)


def test_the_order_is_the_planted_one(made):
    place = (np.arange(CELLS) * 7919 % 1009 + 0.5) / 1009
    for rep, least in ((seriation.BASE, 0.98), (seriation.ODD, 0.95), (seriation.EVEN, 0.95)):
        coord = made[made.rep == rep].set_index("cell")["coord"].astype(float).reindex(range(CELLS)).to_numpy()
        assert abs(spectral.rank_correlation(coord, place)) > least


def test_extension_follows_the_seriated_order(spark, folder, made):
    placed = catalogue.QUERIES["landmark_extension"](spark, folder).toPandas().set_index("cell")
    base = made[made.rep == seriation.BASE].set_index("cell")["coord"].astype(float)
    assert set(placed.index) == set(base.index)
    assert spectral.rank_correlation(placed["hat"].astype(float).reindex(base.index).to_numpy(), base.to_numpy()) > 0.95
    _, summary = seriation.aligned_replicates(spark.createDataFrame(made), Config().boot_min_abs_rho)
    assert set(map(len, placed["boot"])) == {summary["used"]} and summary["used"] >= 36 and summary["failed"] == 40 - summary["used"]
    assert summary["median_rho"] > 0.9 and summary["split_rho"] > 0.9


def test_replicates_and_halves_are_turned(spark):
    n, rng = 60, np.random.default_rng(1)
    base, noise = np.arange(n) / n, rng.random(n)
    coords = {seriation.BASE: base, seriation.ODD: base, seriation.EVEN: 1 - base, 0: base**2, 1: 1 - base, 2: noise, 3: np.where(np.arange(n) < 50, base, np.nan), 4: np.full(n, 0.5)}
    rows = [(r, c, None if np.isnan(x) else float(x), 0.25) for r, xs in coords.items() for c, x in enumerate(xs)]
    made = spark.createDataFrame(rows, "rep int, cell long, coord double, score double")
    kept, summary = seriation.aligned_replicates(made)
    got = kept.toPandas()
    want = {0: base, 1: base} | ({2: None} if abs(spectral.rank_correlation(noise, base)) >= 0.3 else {})
    assert set(got.rep) == set(want) and summary["used"] == len(want) and summary["failed"] == 5 - len(want) and summary["robinson"] == 0.25
    for rep in (0, 1):
        own = got[got.rep == rep].sort_values("cell")["coord"].to_numpy()
        assert np.allclose(own, np.arange(n) / (n - 1))
    both, rho = seriation.halves(made)
    assert rho == pytest.approx(1.0) and both.where("abs(order_odd_blocks - order_even_blocks) > 1e-12").count() == 0
    none, rho = seriation.halves(made.where("rep >= 0"))
    assert none.count() == 0 and rho is None


def test_places_are_the_formula(spark):
    """The centroids of the real tables' cells, worked out again from all pairs' similarities."""
    if not DATA.exists():
        pytest.skip("no test tables")
    t = standin.Tables(spark, f"{DATA}/sf0.01")
    occ = t.occupancy()
    cells = sorted(r.cell for r in occ.select("cell").distinct().collect())
    n, k = len(cells), 10
    half, place = extension.half_window(k, n), {c: (c * 37 % 1009) / 1009 for c in cells}
    pairs = similarity.pair_phi(occ, t.blocks()).collect()
    phi = np.full((n, n), np.nan)
    for r in pairs:
        if r.phi is not None:
            phi[cells.index(r.i), cells.index(r.j)] = phi[cells.index(r.j), cells.index(r.i)] = r.phi
    by = sorted(range(n), key=lambda c: (place[cells[c]], cells[c]))
    phi, at = phi[:, by], np.array([place[cells[c]] for c in by])
    coords = spark.createDataFrame([(c, float(x)) for c, x in place.items()], "cell long, t double")
    got = extension.place(occ, occ, coords, coords.limit(0).selectExpr("cast(0 as int) as rep", "cell", "t as coord"), t.blocks(), k).toPandas().set_index("cell")
    for row, cell in enumerate(cells):
        for name, smooth in (("secondary", phi[row]), ("hat", np.array([np.nanmean(phi[row, max(0, j - half) : j + half + 1]) for j in range(n)]))):
            top = np.argsort(np.where(np.isnan(smooth), -9, smooth))[::-1][:k]
            weight = smooth[top] - smooth[top].min() + 1e-6
            assert got.loc[cell, name] == pytest.approx((weight * at[top]).sum() / weight.sum(), abs=1e-9)


def test_too_few_cells_have_no_place(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    rows = catalogue.QUERIES["landmark_extension"](spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == 15 and {(r.hat, r.secondary, len(r.boot)) for r in rows} == {(None, None, 0)}


def test_neighbours_are_those_of_a_run():
    assert [seriation.neighbour_count(n) for n in (2, 8, 250, 500, 5000)] == [3, 7, 10, 20, 50]
    assert seriation.neighbour_count(500, 12) == 12
    assert np.all([seriation.neighbour_count(n, 30) == 9 for n in (10,)])
