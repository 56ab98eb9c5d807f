"""The whole analysis on cells with a planted order."""

import json

import numpy as np
import pytest

from repliphase.config import Config
from repliphase.functions import spectral
from repliphase.plans import ordering

CHROMS, BINS, WIDTH = 10, 40, 100_000


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 120
    t = rng.permutation((np.arange(n) + 0.5) / n)
    tau = rng.random(CHROMS * BINS)
    rows, seq = [], 0
    for cell in range(n):
        for b in np.flatnonzero(rng.random(len(tau)) < 0.02 + 0.6 * (t[cell] > tau)):
            start = int(b % BINS) * WIDTH + int(rng.integers(1000, WIDTH - 3000))
            for _ in range(3):
                start += int(rng.integers(60, 180))
                rows.append((seq, f"chr{b // BINS + 1}", start, start + 50, f"bc{cell:04d}"))
                seq += 1
    chroms = spark.createDataFrame([(k, f"chr{k + 1}", BINS * WIDTH) for k in range(CHROMS)], "h int, name string, size long")
    anchor = spark.createDataFrame([(int(k // BINS), int(k % BINS * WIDTH), int((k % BINS + 1) * WIDTH), float(1 - tau[k])) for k in range(len(tau))], "h int, s long, e long, value double")
    fragments = spark.createDataFrame(rows, "seq long, chrom string, s long, e long, barcode string")
    config = Config(
        min_fragments=5, minimum_cells=60, breadth_hard_floor=0.02, breadth_min_floor=0.02, breadth_max=0.9, min_profile_events=5, min_structure_excess=0.005, null_shifts=1, n_bootstrap=4, collapse_distance="off",
        fg_min_events=5, graph_bin=WIDTH, graph_smooth_bp=0, n_blocks=10, block_min_bins=10, min_valid_blocks=2, rt_bin=WIDTH, rt_smooth_bp=0, least_rt_bins=100, least_anchor_bins=100, max_order_cells=90, plot_region="chr2:0-2,000,000",
    )
    return t, tau, ordering.Ordering(fragments, chroms, anchor, config=config).run()


def test_order_follows_the_planted_one(planted):
    t, tau, result = planted
    rows = result.order.toPandas()
    truth = np.array([t[int(b[2:])] for b in rows["barcode"]])
    # The anchor is high in early bins and cells late in the cycle have late bins: progression rises with t or falls as a whole.
    assert abs(spectral.rank_correlation(rows["progression"].to_numpy(), truth)) > 0.95
    assert sorted(rows["global_order"]) == list(range(1, len(rows) + 1))
    sizes = rows.groupby("pseudotime_bin").size()
    assert sizes.max() - sizes.min() <= 1
    assert result.summary["quality"]["split_rho"] > 0.7
    assert result.summary["quality"]["extension_rho"] > 0.9
    assert set(rows["is_landmark"]) == {True, False}


def test_track_follows_the_firing_times(planted):
    _, tau, result = planted
    rows = result.track.toPandas()
    place = [(int(c[3:]) - 1) * BINS + s // WIDTH for c, s in zip(rows["chrom"], rows["s"])]
    # The latest bins fire in cells that the structure gate takes out.
    early = tau[place] < 0.7
    assert spectral.rank_correlation(rows["value"].to_numpy()[early], tau[place][early]) > 0.9


def joined(folder):
    return [x for p in sorted(folder.glob("part*")) for x in p.read_text().splitlines()]


def test_outputs(planted, tmp_path):
    _, _, result = planted
    ordering.write(result, str(tmp_path), "x")
    summary = json.loads("\n".join(joined(tmp_path / "x.summary.json")))
    assert summary["counts"]["PASS"] == result.order.count()
    lines = joined(tmp_path / "x.cell_order.tsv")
    assert lines[0].startswith("# ") and lines[1].startswith("# ") and len(lines) == 3 + result.order.count()
    at = lines[2].split("\t").index("global_order")
    assert [int(x.split("\t")[at]) for x in lines[3:]] == list(range(1, len(lines) - 2))
    assert joined(tmp_path / "x.inferred_RT.bedgraph")[0].startswith("track type=bedGraph")
    assert len(joined(tmp_path / "x.qc_metrics.tsv")) == 1 + result.metrics.count()
    assert result.region.count() == result.order.count()
