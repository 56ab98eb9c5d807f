"""Parameters of a run. The defaults are fixed values, lengths in base pairs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    sample: str = "sample"
    chroms: str = "auto+x"
    anchor_high: str = "early"
    flip_order: bool = False
    # Depth and breadth
    min_fragments: int = 1000
    depth_lower_quantile: float = 0.01
    depth_upper_quantile: float = 0.99
    minimum_cells: int = 100
    breadth_hard_floor: float = 0.1
    breadth_min_floor: float = 0.1
    breadth_mad_k: float = 3.0
    breadth_max: float = 0.7
    min_profile_events: int = 200
    # Structure and signal
    min_structure_excess: float = 0.02
    min_structure_z: float = 0.0
    null_shifts: int = 4
    min_frac_signal: float = 0.1
    # Reliability
    max_rank_sd: float = 0.10
    n_bootstrap: int = 40
    boot_min_abs_rho: float = 0.30
    drop_low_confidence: bool = False
    # Events
    collapse_distance: str = "auto"
    collapse_max_bp: int = 1000
    fg_posterior: float = 0.5
    fg_min_events: int = 50
    min_frag_len: int = 0
    max_frag_len: int = 0
    # Graph
    graph_bin: int = 100_000
    graph_smooth_bp: int = 200_000
    graph_autosomes_only: bool = True
    n_blocks: int = 24
    block_min_bins: int = 64
    min_valid_blocks: int = 4
    gram_budget_gb: float = 4.0
    max_order_cells: int = 5000
    knn: int = 0
    refine_rounds: int = 2
    # Outputs
    rt_bin: int = 200_000
    rt_smooth_bp: int = 400_000
    usable_bin_lower_quantile: float = 0.01
    usable_bin_upper_quantile: float = 0.999
    n_bins: int = 16
    plot_region: str | None = None
    plot_bin: int = 50_000
    seed: int = 1
    # Least numbers below which a run is refused
    least_rt_bins: int = 300
    least_anchor_bins: int = 200
    least_gaps: int = 500
    least_landmarks: int = 20

    def __post_init__(self):
        for low, high, name in ((self.depth_lower_quantile, self.depth_upper_quantile, "depth"), (self.usable_bin_lower_quantile, self.usable_bin_upper_quantile, "usable-bin")):
            if not 0 <= low < high <= 1:
                raise ValueError(f"the {name} quantiles must rise within 0 and 1")
        if not 0 <= self.breadth_hard_floor <= self.breadth_max <= 1:
            raise ValueError("the breadth floor must not exceed the breadth maximum")
        if min(self.graph_bin, self.rt_bin, self.plot_bin) <= 0:
            raise ValueError("bins must have a positive width")
        if self.anchor_high not in ("early", "late"):
            raise ValueError("anchor_high is early or late")
