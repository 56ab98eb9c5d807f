"""The whole analysis: fragments to gated cells, their order and the timing track."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.config import Config
from repliphase.functions import ranks, stats
from repliphase.functions.storage import settled
from repliphase.operators import events, extension, foreground, gates, intervals, matrix, seriation, similarity, timing
from repliphase.sources import sinks, text_tables

log = logging.getLogger("repliphase")


@dataclass
class Result:
    metrics: DataFrame
    order: DataFrame
    track: DataFrame
    region: DataFrame | None
    summary: dict
    warnings: list[str] = field(default_factory=list)


class Ordering:
    def __init__(self, fragments: DataFrame, chroms: DataFrame, anchor: DataFrame, blacklist: DataFrame | None = None, config: Config | None = None):
        """``fragments`` (seq, chrom, s, e, barcode), ``chroms`` (h, name, size), ``anchor`` (h, s, e, value), ``blacklist`` (h, s, e)."""
        self.c, self.chroms, self.anchor, self.warnings = config or Config(), chroms, anchor, []
        self.spark = fragments.sparkSession
        none = self.spark.createDataFrame([], "h int, s long, e long")
        self.blacklist = intervals.merge(blacklist) if blacklist is not None else none
        self.fragments = fragments

    def warn(self, text: str) -> None:
        self.warnings.append(text)
        log.warning(text)

    def run(self) -> Result:
        c, chroms = self.c, self.chroms
        blocked = {w: intervals.bin_fraction(chroms, self.blacklist, w) for w in (c.rt_bin, c.graph_bin)}
        anchor = settled(intervals.bin_means(chroms, self.anchor, c.rt_bin))
        if anchor.count() < c.least_anchor_bins:
            raise ValueError("the anchor covers too few bins")

        # Cells are numbered by barcode, from all valid fragments, so a cell of blacklisted ones only stays in the result.
        valid = text_tables.valid_fragments(self.fragments, chroms, c.min_frag_len, c.max_frag_len)
        names = valid.groupBy("barcode").agg(F.count("*").alias("n_total"))
        names = settled(ranks.numbered(names, ["barcode"], "cell"))
        flagged = intervals.flag_hits(text_tables.midpoints(valid), self.blacklist, "black").join(names.select("barcode", "cell"), "barcode")
        flagged = settled(flagged.select("seq", "cell", "h", "p", "black"))
        raw = flagged.where("not black").drop("black")
        black = flagged.groupBy("cell").agg(F.avg(F.col("black").cast("double")).alias("frac_blacklist"))

        if c.collapse_distance in ("off", "none", "0"):
            distance, info = 0, {"mode": "off"}
        elif c.collapse_distance == "auto":
            distance, info = events.collapse_distance(events.pooled_gaps(raw, sample_cells=400, seed=c.seed), c.collapse_max_bp)
        else:
            distance, info = int(c.collapse_distance), {"mode": "user"}
        model = settled(events.collapse(raw, chroms, distance))
        gaps = events.adjacent_gaps(model).where("gap is not null")
        if gaps.count() < c.least_gaps:
            raise ValueError("too few gaps between events")
        mixture = foreground.fit_mixture(gaps)
        if mixture is None:
            raise ValueError("the gap mixture does not separate")
        marked = settled(foreground.foreground(model, mixture, c.fg_posterior, min_events=c.fg_min_events).select("seq", "cell", "h", "p", "foreground"))
        signal = marked.where("foreground").drop("foreground")

        usable = settled(events.usable_bins(raw, chroms, c.rt_bin, blocked[c.rt_bin], anchor, c.usable_bin_lower_quantile, c.usable_bin_upper_quantile))
        if (n_usable := usable.count()) < c.least_rt_bins:
            raise ValueError(f"{n_usable} usable bins are too few")
        cells = self._cell_table(names, raw, black, signal, marked, usable, anchor)
        gate = gates.Gates(c.min_fragments, c.depth_lower_quantile, c.depth_upper_quantile, c.breadth_hard_floor, c.breadth_min_floor, c.breadth_mad_k, c.breadth_max, c.min_profile_events, c.min_frac_signal)
        judged = settled(gates.status(cells.where("n > 0").withColumnsRenamed({"breadth_raw": "breadth", "profile_events": "n_signal"}), gate))
        passed = judged.where("status = 'PASS'").select("cell")
        if passed.count() < c.minimum_cells:
            raise ValueError("too few cells pass the gates")

        cols = settled(matrix.columns(chroms, c.graph_bin, blocked[c.graph_bin], c.graph_autosomes_only))
        occ = matrix.occupancy(signal.join(passed, "cell", "left_semi"), chroms, c.graph_bin, cols)
        occ = settled(matrix.dilate(occ, cols, round(c.graph_smooth_bp / c.graph_bin)))
        placed = settled(self._place(occ, cols, passed))
        status = judged.select("cell", "status").join(placed.select("cell", F.col("status").alias("_late")), "cell", "left").select("cell", F.coalesce("_late", "status").alias("status"))

        final = placed.where("status = 'PASS'")
        if (n_final := final.count()) < c.minimum_cells:
            raise ValueError("too few cells survive the gates")
        ordered, orientation = self._order(final, cells)
        held = matrix.cell_bins(signal, chroms, c.rt_bin)
        track = timing.shrunk_means(held, ordered, usable)
        track = settled(timing.running_median(track, c.rt_bin, c.rt_smooth_bp))
        track_rho = stats.spearman(track.join(anchor, ["h", "bin"]), "smooth", "value").first().rho
        if track_rho is not None and abs(track_rho) < 0.3:
            self.warn(f"the timing track correlates only {track_rho:+.3f} with the anchor")

        kept = ordered.select("cell").withColumn("_in", F.lit(True))
        status = status.join(kept, "cell", "left").select("cell", F.when((F.col("status") == "PASS") & F.col("_in").isNull(), "UNPLACEABLE_FAIL").otherwise(F.col("status")).alias("status"))
        metrics = self._metrics(cells, status, placed, ordered)
        region = text_tables.parse_region(c.plot_region, chroms)
        if c.plot_region and region is None:
            self.warn(f"the region {c.plot_region!r} cannot be read")
        counts = None if region is None else matrix.region_counts(raw, region[0], region[1], region[2], c.plot_bin).groupBy("cell").agg(F.sum("n").alias("region_events")).join(metrics, "cell", "right").where("global_order is not null").withColumn("region_events", F.coalesce("region_events", F.lit(0)))
        summary = self._summary(metrics, ordered, cells, distance, info, mixture, n_usable, n_final, orientation, track_rho)
        return Result(metrics, metrics.where("status = 'PASS'"), timing.bedgraph(track, chroms, c.rt_bin), counts, summary, self.warnings)

    def _cell_table(self, names, raw, black, signal, marked, usable, anchor) -> DataFrame:
        c, chroms = self.c, self.chroms
        by = [
            events.depth(raw), black,
            events.breadth(raw, chroms, c.rt_bin, usable, "breadth_raw").select("cell", "breadth_raw"),
            events.breadth(signal, chroms, c.rt_bin, usable, "breadth_signal").select("cell", "breadth_signal", F.col("n_events").alias("profile_events")),
            foreground.signal_fraction(marked).select("cell", F.col("n_signal").alias("n_signal_events"), "frac_signal"),
            events.cell_anchor(signal, chroms, c.rt_bin, usable, anchor),
        ]
        cells = names
        for part in by:
            cells = cells.join(part, "cell", "left")
        zero = ["n", "log_depth", "breadth_raw", "breadth_signal", "profile_events", "n_signal_events", "frac_signal"]
        return settled(cells.fillna(0, zero))

    def _place(self, occ: DataFrame, cols: DataFrame, passed: DataFrame) -> DataFrame:
        """Coordinates and statuses of the cells that passed the first gates."""
        c = self.c
        sizes = settled(passed.join(matrix.support(occ), "cell", "left").fillna(0, ["support"]))
        marks = settled(matrix.pick_landmarks(sizes, c.max_order_cells))
        n_land = marks.count()
        budget = int(c.gram_budget_gb * 1e9 / max(4.0 * n_land**2, 1.0)) - 2
        block_of = settled(matrix.blocks(cols, c.n_blocks, budget, c.block_min_bins))
        n_blocks = block_of.agg(F.max("block")).first()[0] + 1
        if n_blocks < 8:
            self.warn(f"only {n_blocks} blocks; the uncertainty will be coarse")
        info = matrix.information(occ, block_of)
        least_valid = int(np.clip(c.min_valid_blocks, 1, max(1, n_blocks // 2)))
        k = seriation.neighbour_count(n_land, c.knn)
        land = settled(occ.join(marks, "cell", "left_semi"))

        shifts = [similarity.nearest(matrix.circular_shift(land, cols, r), block_of, k).select("i", "contrast") for r in range(max(1, c.null_shifts))]
        null = shifts[0]
        for more in shifts[1:]:
            null = null.union(more)
        knots = settled(stats.binned_baseline(settled(null.join(sizes, F.col("i") == F.col("cell")).select("contrast", "support")), "contrast", "support"))
        first = similarity.nearest(land, block_of, k).select(F.col("i").alias("cell"), "contrast")

        def structured(contrasts: DataFrame, rows: DataFrame) -> DataFrame:
            rows = rows.join(contrasts, "cell", "left").join(sizes, "cell").join(info, "cell", "left")
            rows = stats.along_baseline(rows, "support", knots)
            rows = rows.withColumn("excess", F.col("contrast") - F.col("null_mean")).withColumn("z", F.col("excess") / F.col("null_sd"))
            return gates.structure_status(rows, c.min_structure_excess, c.min_structure_z, least_valid)

        judged = settled(structured(first, marks.select("cell")))
        good = judged.where("status = 'PASS'").count()
        if good < n_land and good < min(c.minimum_cells, n_land):
            self.warn("the structure gates would leave too few landmarks; all are kept")
            judged = judged.withColumn("status", F.lit("PASS"))
            good = n_land
        if good < c.least_landmarks:
            raise ValueError("too few landmarks for an order")
        kept = settled(judged.where("status = 'PASS'").select("cell"))
        own = settled(land.join(kept, "cell", "left_semi"))
        made = settled(seriation.seriate_replicates(own, block_of, k, c.n_bootstrap, c.refine_rounds, c.seed))
        replicates, self.seriation = seriation.aligned_replicates(made, c.boot_min_abs_rho)
        if self.seriation["failed"] > 0.25 * max(c.n_bootstrap, 1):
            self.warn(f"{self.seriation['failed']} of {c.n_bootstrap} replicates failed")
        coords = settled(made.where(f"rep = {seriation.BASE} and coord is not null").select("cell", F.col("coord").alias("t")))
        halves, _ = seriation.halves(made)

        failed = judged.where("status <> 'PASS'").select("cell")
        pending = passed.join(coords, "cell", "left_anti").join(failed, "cell", "left_anti")
        out = judged.select("cell", "status", "contrast", "excess", "z", "support", "valid_blocks", "info_weight").join(coords, "cell", "left").withColumn("secondary", F.lit(None).cast("double"))
        out = out.where("t is not null or status <> 'PASS'").withColumn("is_landmark", F.lit(True))
        boots = replicates.select("rep", "cell", "coord")
        if pending.take(1):
            targets = pending.union(coords.select("cell")).distinct()
            spots = settled(extension.place(occ.join(targets, "cell", "left_semi"), own, coords, replicates, block_of, k))
            loo = spots.join(coords, "cell")
            rho = stats.spearman(loo, "hat", "t").first().rho
            self.seriation["extension_rho"] = rho
            if rho is not None and rho < 0.95:
                self.warn(f"the extension follows the exact order only at {rho:.3f}")
            mapped = stats.quantile_map(loo, "hat", "t", pending.join(spots, "cell", "left"), "hat", "t")
            rest = structured(mapped.select("cell", "contrast"), pending).join(mapped.select("cell", "t", "secondary"), "cell")
            rest = rest.withColumn("status", F.when((F.col("status") == "PASS") & F.col("t").isNull(), "UNPLACEABLE_FAIL").otherwise(F.col("status")))
            rest = rest.join(marks.select("cell", F.lit(True).alias("_mark")), "cell", "left").withColumn("is_landmark", F.coalesce("_mark", F.lit(False)))
            out = out.drop("secondary").join(spots.select("cell", "secondary"), "cell", "left")
            out = out.unionByName(rest.select(*out.columns))
            boots = boots.union(self._calibrated(spots, replicates, pending))
        self.boots = settled(boots)
        return out.join(halves, "cell", "left")

    def _calibrated(self, spots: DataFrame, replicates: DataFrame, pending: DataFrame) -> DataFrame:
        """Rows (rep, cell, coord) of pending cells, each replicate's hats mapped to its landmarks' coordinates."""
        reps = sorted(r.rep for r in replicates.select("rep").distinct().collect())
        names = F.array(*map(F.lit, reps)).cast("array<int>")
        hats = spots.select("cell", F.posexplode("boot").alias("k", "hat")).select(F.get(names, F.col("k")).alias("rep"), "cell", "hat")
        pairs = hats.join(replicates.select("rep", "cell", "coord"), ["rep", "cell"])
        return stats.quantile_map(pairs, "hat", "coord", hats.join(pending, "cell", "left_semi"), "hat", "coord", keys=["rep"]).select("rep", "cell", "coord")

    def _order(self, final: DataFrame, cells: DataFrame) -> tuple[DataFrame, dict]:
        """Rows (cell, progression, ...) of the placed cells, and how the axis was turned."""
        c = self.c
        rows = final.withColumn("second", F.coalesce("secondary", "t"))
        ordered = settled(timing.total_order(rows, ["t", "second", "cell"]).join(cells.select("cell", "cell_anchor"), "cell"))
        # Every replicate has the same knots; a copy for each lets them be mapped side by side.
        reps = [r.rep for r in self.boots.select("rep").distinct().collect()]
        knots = ordered.select("t", "progression", F.explode(F.array(*map(F.lit, reps)).cast("array<int>")).alias("rep"))
        mapped = stats.quantile_map(knots, "t", "progression", self.boots.join(ordered.select("cell"), "cell", "left_semi"), "coord", "p", 5, keys=["rep"])
        spread = stats.reduce_replicates(mapped, "cell", "p").withColumnsRenamed({"n_used": "n_bootstrap_used", "sd": "rank_sd", "lo10": "rank_lo10", "hi90": "rank_hi90"})
        flip, rho = timing.orientation(ordered, "progression", "cell_anchor", c.anchor_high, c.flip_order)
        if rho is None:
            self.warn("the anchor carries no signal; the direction is not established")
        elif abs(rho) < 0.25:
            self.warn(f"the correlation of the order with the anchor, {rho:+.3f}, is weak")
        ordered = ordered.join(spread, "cell", "left").withColumn("point_coordinate", F.col("t"))
        if flip:
            turned = {x: 1 - F.col(x) for x in ("progression", "point_coordinate", "order_odd_blocks", "order_even_blocks")}
            ordered = ordered.withColumns(turned | {"rank_lo10": 1 - F.col("rank_hi90"), "rank_hi90": 1 - F.col("rank_lo10")})
        ordered = ordered.withColumn("low_confidence", F.coalesce(F.col("rank_sd") > c.max_rank_sd, F.lit(False)))
        if c.drop_low_confidence:
            ordered = ordered.where("not low_confidence")
            ordered = timing.total_order(ordered, ["progression"])
        else:
            ordered = ranks.numbered(ordered.drop("global_order"), ["progression"], "global_order")
        return settled(timing.tiles(ordered, "global_order", max(1, c.n_bins))), {"flipped": flip, "anchor_rho": None if rho is None else (-rho if flip else rho)}

    def _metrics(self, cells: DataFrame, status: DataFrame, placed: DataFrame, ordered: DataFrame) -> DataFrame:
        rows = cells.join(status, "cell", "left").withColumn("status", F.coalesce("status", F.lit("NO_FRAGMENTS")))
        rows = gates.with_reason(rows).join(placed.select("cell", "is_landmark", "contrast", "excess", "z", "valid_blocks", "info_weight"), "cell", "left")
        rows = rows.join(ordered.select("cell", "progression", "point_coordinate", "rank_sd", "rank_lo10", "rank_hi90", "n_bootstrap_used", "low_confidence", "order_odd_blocks", "order_even_blocks", "global_order", "pseudotime_bin"), "cell", "left")
        return settled(rows.select(
            "cell", "barcode", "status", F.col("reason").alias("filter_reason"), (F.col("status") == "PASS").alias("pass"),
            F.col("n").alias("n_fragments_raw"), F.col("log_depth").alias("log10_fragments"), "frac_blacklist", "n_signal_events", "frac_signal", "breadth_raw", "breadth_signal", "profile_events", "cell_anchor",
            F.col("contrast").alias("similarity_contrast"), F.col("excess").alias("structure_excess"), F.col("z").alias("structure_z"), F.col("valid_blocks").alias("n_valid_blocks"), "info_weight", (F.col("breadth_raw") >= self.c.breadth_max).alias("oversaturated"),
            "progression", "point_coordinate", "rank_sd", "rank_lo10", "rank_hi90", "n_bootstrap_used", "low_confidence", "order_odd_blocks", "order_even_blocks", F.coalesce("is_landmark", F.lit(False)).alias("is_landmark"), "global_order", "pseudotime_bin",
        ))

    def _summary(self, metrics, ordered, cells, distance, info, mixture, n_usable, n_final, orientation, track_rho) -> dict:
        kept = metrics.where("status = 'PASS'")
        confounds = {x: stats.spearman(kept, "progression", x).first().rho for x in ("log10_fragments", "breadth_raw", "frac_signal", "frac_blacklist")}
        spread = kept.agg(F.percentile("rank_sd", F.lit(0.5)).alias("m"), F.count_if("low_confidence").alias("n")).first()
        return {
            "sample": self.c.sample,
            "counts": {r.status: r.n for r in gates.status_counts(metrics).collect()},
            "n_final": n_final,
            "usable_rt_bins": n_usable,
            "collapse": {"distance": distance, **info},
            "mixture": {"short_median_bp": float(np.exp(mixture.mean1)), "long_median_bp": float(np.exp(mixture.mean2)), "short_weight": mixture.weight},
            "quality": {**self.seriation, "median_rank_sd": spread.m, "n_low_confidence": spread.n, "rt_anchor_rho": track_rho},
            "orientation": orientation,
            "confounding": confounds,
            "warnings": self.warnings,
        }


def write(result: Result, folder: str, sample: str) -> None:
    """The tables, track and summary of a run below ``folder``, which may be any path that Spark can write."""
    base = f"{folder.rstrip('/')}/{sample}"
    metrics = result.metrics.drop("cell")
    dropped = metrics.where("not pass").select("barcode", "status", "filter_reason", "n_fragments_raw", "log10_fragments", "frac_blacklist", "frac_signal", "breadth_raw", "breadth_signal", "profile_events", "structure_excess")
    sinks.write_ordered(metrics, f"{base}.qc_metrics.tsv", ["barcode"])
    sinks.write_ordered(dropped, f"{base}.dropped_cells.tsv", ["barcode"])
    sinks.write_ordered(result.order.drop("cell"), f"{base}.cell_order.tsv", ["global_order"], [f"order of {sample}", "progression rises from early to late"])
    sinks.write_bins(result.order, f"{folder.rstrip('/')}/bins")
    sinks.write_bedgraph(result.track, f"{base}.inferred_RT.bedgraph", f"{sample} inferred RT")
    if result.region is not None:
        region = result.region.select("barcode", "progression", "global_order", "pseudotime_bin", "rank_sd", "low_confidence", "n_fragments_raw", "breadth_raw", "region_events")
        sinks.write_ordered(region, f"{base}.region_support.tsv", ["progression", "global_order"])
    sinks.write_summary(result.metrics.sparkSession, result.summary, f"{base}.summary.json")
