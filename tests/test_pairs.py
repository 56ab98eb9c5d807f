"""Similarity over copies of cells and in small chunks, against all pairs worked out in NumPy."""

import numpy as np
import pytest

from repliphase.functions import spectral
from repliphase.operators import extension, report, seriation, similarity, timing

BLOCKS, WIDE = 3, 15


@pytest.fixture(scope="module")
def cells():
    """Some cells of equal occupancy with others between them, an empty block here and there, and a cell without any information."""
    rng = np.random.default_rng(6)
    kinds = (rng.random((9, BLOCKS * WIDE)) < 0.4).astype(float)
    kinds[0, :WIDE], kinds[1, WIDE:] = 0, 0
    kinds[2] = np.repeat([1, 0, 1], WIDE)
    return kinds[rng.integers(0, 9, 40)]


@pytest.fixture(scope="module")
def tables(spark, cells):
    occ = spark.createDataFrame([(int(c), 0, int(k)) for c, k in zip(*np.nonzero(cells))], "cell long, h int, col long")
    return occ, spark.createDataFrame([(k, k // WIDE, WIDE) for k in range(BLOCKS * WIDE)], "col long, block int, n_bins long")


@pytest.fixture(scope="module")
def phi(cells):
    num, den = np.zeros((2, len(cells), len(cells)))
    for b in range(BLOCKS):
        m = cells[:, b * WIDE : (b + 1) * WIDE]
        p, w = similarity.block_phi(m, m)
        num, den = num + p * w, den + w
    out = np.where(den > 0, num / np.where(den > 0, den, 1), np.nan)
    np.fill_diagonal(out, np.nan)
    return out


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 7)
    monkeypatch.setattr(similarity, "_INNER", 3)


def test_the_best_of_chunks_are_the_best_of_all():
    rng = np.random.default_rng(1)
    values = np.where(rng.random((30, 200)) < 0.1, np.nan, rng.integers(0, 40, (30, 200)) / 7 + rng.random((30, 200)) * 1e-12)
    values[3] = np.nan
    values[4, 5:] = np.nan
    best = spectral.Best(30, 12)
    for at in range(0, 200, 17):
        best.add(values[:, at : at + 17], at)
    columns, wanted = spectral.largest(values, 12)
    ok = np.isfinite(wanted)
    assert ((best.at >= 0) == ok).all() and (best.at[ok] == columns[ok]).all() and (best.value[ok] == wanted[ok]).all()


def test_nearest_of_copies(tables, phi):
    found = {r.i: r for r in similarity.nearest(*tables, 5).collect()}
    for c, row in enumerate(phi):
        ok = np.flatnonzero(np.isfinite(row))
        if not len(ok):
            assert c not in found
            continue
        top = ok[np.lexsort((ok, -np.round(row[ok], 9)))][:5]
        assert [x.j for x in found[c].near] == top.tolist()
        assert found[c].contrast == pytest.approx(row[top].mean() - row[ok].mean(), abs=1e-12)


@pytest.mark.parametrize("tile", [4, 512])
def test_sums_over_pairs(spark, tables, phi, tile):
    n = len(phi)
    order = timing.total_order(spark.createDataFrame([(c, c * 17 % 41) for c in range(n)], "cell long, x long"), ["x", "cell"])
    t = np.empty(n)
    for r in order.collect():
        t[r.cell] = r.progression
    i, j = np.triu_indices(n, 1)
    ok = np.isfinite(phi[i, j])
    d, p = np.abs(t[i] - t[j])[ok], phi[i, j][ok]
    row = similarity.pair_rank_correlation(*tables, order, 50, tile).first()
    assert row.n == ok.sum() < len(i)
    assert row.rho == pytest.approx(spectral.rank_correlation(-np.round(d, 9), np.round(p, 9)), abs=1e-12)
    at = np.minimum((d * 8).astype(int), 7)
    want = {b: ((at == b).sum(), p[at == b].mean()) for b in np.unique(at)}
    got = {r.bin: (r.n, r.phi) for r in similarity.pair_decay(*tables, order, 8, tile).collect()}
    assert {b: n for b, (n, _) in got.items()} == {b: n for b, (n, _) in want.items()}
    assert all(got[b][1] == pytest.approx(want[b][1]) for b in want)
    few = order.where("cell < 5")
    assert report.robinson_score(*tables, few).first().rho is None and report.robinson_score(*tables, few).first().n <= 10


def test_no_plan_joins_or_stores_pairs(spark, tables):
    order = timing.total_order(tables[0].select("cell").distinct(), ["cell"])
    for made in (report.similarity_decay(*tables, order), similarity.pair_phi(*tables), similarity.nearest(*tables, 5)):
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_places_and_sketches_in_chunks(spark, tables, monkeypatch):
    occ, blocks = tables
    coords = spark.createDataFrame([(c, (c * 7 % 41) / 41) for c in range(40)], "cell long, t double")
    reps = spark.createDataFrame([], "rep int, cell long, coord double")

    def both():
        placed = {r.cell: (r.hat, r.secondary, r.contrast) for r in extension.place(occ, occ, coords, reps, blocks, 6).collect()}
        return placed, {(r.rep, r.cell): r.coord for r in seriation.seriate_replicates(occ, blocks, 8, 2).collect()}

    placed, ordered = both()
    monkeypatch.setattr(similarity, "CHUNK", 4096)
    monkeypatch.setattr(similarity, "_INNER", 512)
    whole = both()
    assert set(placed) == set(whole[0]) and all(placed[c] == pytest.approx(whole[0][c]) for c in placed)
    assert set(ordered) == set(whole[1]) and all(ordered[k] == pytest.approx(whole[1][k], nan_ok=True) for k in ordered)


def test_values_of_pairs_come_in_turns(spark, tables, phi, monkeypatch):
    """However few values may be shuffled at a time, the correlation is that over all pairs."""
    n = len(phi)
    order = timing.total_order(spark.createDataFrame([(c, c * 17 % 41) for c in range(n)], "cell long, x long"), ["x", "cell"])
    whole = similarity.pair_rank_correlation(*tables, order, 50, 8).first()
    turns = []
    monkeypatch.setattr(similarity.storage, "release", lambda spark: turns.append(spark))
    monkeypatch.setattr(similarity, "MOST_SORTED", 3)
    monkeypatch.setattr(similarity, "MOST_SHUFFLED", 20)
    few = similarity.pair_rank_correlation(*tables, order, 50, 8).first()
    assert len(turns) > 2 and few.n == whole.n and few.rho == pytest.approx(whole.rho, abs=1e-12)
    assert similarity._dealt(np.array([2, 9, 1, 1, 0, 5]), 4).tolist() == [0, 1, 2, 2, 2, 3]


def test_weights_of_few_bytes_and_one_side_at_a_time():
    """Products of centred rows are phi, with counts beyond a byte too; landmarks are unpacked as they are met."""
    rng = np.random.default_rng(4)
    parts = [(rng.random((20, n)) < p).astype(np.float32) for n, p in ((700, 0.5), (40, 0.1), (9, 0.0))]
    parts[0][3] = parts[1][5] = 1
    num = den = 0
    for m in parts:
        x, w = similarity.block_phi(m, m)
        num, den = num + x * w, den + w
    side = similarity.Side(parts)
    assert np.allclose(similarity.combined(side, iter([side])), np.where(den > 0, num / np.where(den > 0, den, 1), np.nan), atol=1e-14, equal_nan=True)
    assert [w.dtype.itemsize for _, w in side.weighed(side)] == [2, 1, 1]
    packed = np.concatenate([np.packbits(m.astype(bool), axis=1) for m in parts], 1)
    sides = similarity.Held(np.arange(20), np.arange(749), [(0, 700), (700, 740), (740, 749)], packed).sides(slice(0, 20))
    assert iter(sides) is sides and sum(len(s.parts[0][0]) for s in sides) == 20
