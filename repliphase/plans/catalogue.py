"""The library's queries over the stand-in tables, each with DuckDB SQL for the same rows.

Floats are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repliphase.config import Config
from repliphase.functions import genome, ranks, stats
from repliphase.functions.storage import settled, shared_folder
from repliphase.operators import events, extension, foreground, gates, intervals, matrix, report, seriation, similarity, timing
from repliphase.plans.standin import GRAPH, PREFIX, RT, SIZE, Tables, merged_sql, means_sql, phi_sql, planted_place
from repliphase.sources import bam, bgzf, text_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None, *more: str):
    """Registers a function of Tables under its name, with SQL over the common expressions."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, path: make(Tables(spark, path))
        if sql is not None:
            ORACLES[make.__name__] = ",\n".join([PREFIX, *more]) + "\n" + sql
        return make

    return register


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@_query("""SELECT h, b AS bin, upto - nbin + b AS gbin, b * 100000 AS "start", least((b + 1) * 100000, size) AS stop FROM (
  SELECT *, sum(nbin) OVER (ORDER BY h)::BIGINT AS upto, unnest(range(nbin)) AS b FROM (SELECT h, max(p) + 1 AS size, (max(p) + 100000) // 100000 AS nbin FROM ev GROUP BY h))""")
def grid_bins(t):
    """Chromosomes as long as their last event says."""
    return genome.grid(t.events().groupBy("h").agg((F.max("p") + 1).alias("size")), 100_000)


@_query(r"""SELECT name, core, core ~ '^[0-9]+$' AS autosome, size, row_number() OVER (ORDER BY cls, num, name) AS rank FROM (
  SELECT *, CASE WHEN core ~ '^[0-9]+$' THEN 0 WHEN core = 'X' THEN 1 WHEN core = 'Y' THEN 2 ELSE 3 END AS cls, CASE WHEN core ~ '^[0-9]+$' THEN core::BIGINT ELSE 0 END AS num
  FROM (SELECT name, regexp_replace(name, '^[cC][hH][rR]', '') AS core, max(size) AS size FROM (
    SELECT CASE p_partkey % 3 WHEN 0 THEN 'chr' WHEN 1 THEN 'Chr' ELSE '' END || CASE WHEN p_partkey % 31 = 23 THEN 'X' WHEN p_partkey % 31 = 24 THEN 'Y' WHEN p_partkey % 31 = 25 THEN 'Un_' || (p_partkey % 7) ELSE (p_partkey % 31)::VARCHAR END AS name, p_partkey * 10007 AS size FROM part)
    GROUP BY name HAVING max(size) > 1000000))""")
def chrom_select_sort(t):
    name = "concat(case p_partkey % 3 when 0 then 'chr' when 1 then 'Chr' else '' end, case when p_partkey % 31 = 23 then 'X' when p_partkey % 31 = 24 then 'Y' when p_partkey % 31 = 25 then concat('Un_', p_partkey % 7) else cast(p_partkey % 31 as string) end)"
    rows = t.read("part").selectExpr(f"{name} as name", "p_partkey * 10007 as size").groupBy("name").agg(F.max("size").alias("size")).where(f"size > {genome.MIN_CHROM_SIZE}")
    ranked = ranks.numbered(rows, genome.natural_order(rows), "rank")
    return ranked.select("name", genome.chrom_core(F.col("name")).alias("core"), genome.is_autosome(F.col("name")).alias("autosome"), "size", "rank")


@_query("SELECT * FROM (" + merged_sql("bo") + ")")
def interval_merge(t):
    return intervals.merge(t.blacklist(overlapping=True))


@_query("SELECT seq, cell, h, p FROM ev WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.h = ev.h AND s <= p AND p < e)")
def blacklist_antijoin(t):
    return intervals.outside(t.events(), t.merged()).select("seq", "cell", "h", "p")


@_query("""SELECT cell, count(*) AS n, count(*) FILTER (hit) AS n_black, round((count(*) FILTER (hit)) / count(*)::DOUBLE, 6) AS frac
FROM (SELECT cell, EXISTS (SELECT 1 FROM bm WHERE bm.h = ev.h AND s <= p AND p < e) AS hit FROM ev) GROUP BY cell""")
def blacklist_flag_fraction(t):
    rows = intervals.flag_hits(t.events(), t.merged()).groupBy("cell").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_black"))
    return rows.withColumn("frac", F.round(F.col("n_black") / F.col("n"), 6))


@_query("SELECT h, bin, round(fraction, 6) AS fraction FROM fr")
def blacklist_bin_fraction(t):
    return intervals.bin_fraction(t.chroms(), t.merged(), RT).select("h", "bin", *_six("fraction"))


@_query("SELECT h, bin, round(value, 6) AS value FROM (" + means_sql(100_000) + ")")
def bedgraph_to_bins(t):
    return intervals.bin_means(t.chroms(), t.anchor(), 100_000).select("h", "bin", *_six("value"))


@_query("SELECT * FROM sf")
def sam_cigar_fragments(t):
    return text_tables.sam_fragments(t.sam(), min_mapq=10)


def _new_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}-{name}"


def _as_bam(t: Tables) -> str:
    """The alignments as a folder of BAM files."""
    rows, target = t.sam(), _new_folder(t, "bam")
    refs = sorted(map(tuple, rows.groupBy("chrom").agg(F.max("pos")).collect()))  # a row per chromosome
    rows = rows.select(F.col("seq").cast("string").alias("name"), F.lit(0).alias("flag"), "chrom", "pos", "mapq", "cigar", "tags")
    bam.write(bam.encode(rows, refs), target, bam.header_of("@HD\tVN:1.6\n", refs))
    return target


@_query("SELECT * FROM sf")
def bam_fragments(t):
    rows = bam.read(t.spark, _as_bam(t), columns=["name", "chrom", "pos", "mapq", "cigar", "tags"], split=1 << 22)
    return text_tables.sam_fragments(rows.withColumn("seq", F.col("name").cast("long")), min_mapq=10)


_SPAN = r"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[MDN=X]', 1), lambda x: x::BIGINT)), 0)"


@_query(f"SELECT seq, pos, stop FROM (SELECT *, pos - 1 + greatest(1, {_SPAN})::BIGINT AS stop FROM sam) WHERE chrom = 'RF' AND pos <= 60 AND stop > 20")
def bam_region(t):
    rows = bam.read(t.spark, _as_bam(t), columns=["name", "pos", "stop"], region=("RF", 20, 60), split=1 << 22, granule=1 << 16)
    return rows.select(F.col("name").cast("long").alias("seq"), "pos", "stop")


@_query("SELECT sf.* FROM sf WHERE barcode IN (SELECT DISTINCT c_custkey::VARCHAR FROM customer WHERE c_mktsegment = 'BUILDING')")
def bam_valid_barcodes(t):
    wanted = t.barcodes().select(F.col("cell").cast("string").alias("barcode"))
    target = _new_folder(t, "valid")
    rows = bam.filter_bam(t.spark, _as_bam(t), target, wanted, split=1 << 22, columns=("name", "chrom", "pos", "mapq", "cigar", "tags"))
    return text_tables.sam_fragments(rows.withColumn("seq", F.col("name").cast("long")), min_mapq=10)


@_query("SELECT chrom, s, e, barcode FROM sf")
def bgzf_fragments(t):
    target = _new_folder(t, "fragments.tsv.gz")
    rows = text_tables.sam_fragments(t.sam(), min_mapq=10)
    bgzf.write_lines(rows.select(F.concat_ws("\t", "chrom", "s", "e", "barcode").alias("value")), target)
    return text_tables.read_fragments(t.spark, target, split=1 << 20).drop("seq")


@_query("SELECT barcode, count(*) AS n FROM sf GROUP BY barcode")
def cb_counts(t):
    return text_tables.barcode_counts(text_tables.sam_fragments(t.sam(), min_mapq=10))


@_query("SELECT seq, cell FROM ev WHERE cell IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def barcode_semi_join(t):
    return text_tables.keep_barcodes(t.events(), t.barcodes(), "cell").select("seq", "cell")


@_query("""SELECT seq, CASE chrom WHEN 'AF' THEN 0 WHEN 'NF' THEN 1 ELSE 2 END AS h, barcode, (s + e) // 2 AS p FROM sf
WHERE chrom IN ('AF', 'NF', 'NO') AND e > s AND e - s BETWEEN 12 AND 45""")
def fragment_midpoint_filter(t):
    chroms = t.spark.createDataFrame([(0, "AF"), (1, "NF"), (2, "NO")], "h int, name string")
    return text_tables.midpoints(text_tables.valid_fragments(text_tables.sam_fragments(t.sam(), min_mapq=10), chroms, 12, 45))


@_query("SELECT seq, cell, h, gap FROM gaps")
def adjacent_gaps(t):
    return events.adjacent_gaps(t.events()).select("seq", "cell", "h", "gap")


@_query("SELECT count(*) AS n, round(avg((gap < 300)::INT), 6) AS short_fraction, max(gap) AS longest FROM (SELECT gap // 500 + 1 AS gap FROM gaps WHERE gap < 1000000)")
def gap_pool_statistics(t):
    rows = events.pooled_gaps(t.events()).selectExpr("gap div 500 + 1 as gap")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gap") < 300).cast("double")), 6).alias("short_fraction"), F.max("gap").alias("longest"))


_HIST = """hist AS (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(240)) AS bin) b LEFT JOIN (
  SELECT least(floor(round(log10(gap) / 0.025::DOUBLE, 9))::BIGINT, 239) AS bin, count(*) AS n FROM (SELECT gap // 500 + 1 AS gap FROM gaps WHERE gap < 1000000) WHERE log10(gap) <= 6 GROUP BY 1) x ON x.bin = b.bin),
kern AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-0.5::DOUBLE * (d / 2.0::DOUBLE) ** 2) AS w FROM (SELECT unnest(range(-6, 7)) AS d))),
sm AS (SELECT hist.bin + d AS bin, round(sum(n * w), 9) AS smooth, (hist.bin + d + 0.5::DOUBLE) * 0.025::DOUBLE AS centre FROM hist, kern WHERE hist.bin + d BETWEEN 0 AND 239 GROUP BY hist.bin + d)"""


@_query("SELECT bin, n FROM hist", _HIST)
def gap_histogram(t):
    return stats.log10_histogram(events.pooled_gaps(t.events()).selectExpr("gap div 500 + 1 as gap"), "gap")


@_query("SELECT bin, round(smooth, 6) AS smooth FROM sm", _HIST)
def histogram_smooth(t):
    return events.antimode_table(events.pooled_gaps(t.events()).selectExpr("gap div 500 + 1 as gap")).select("bin", *_six("smooth"))


@_query("""SELECT CASE WHEN n < 1000 OR short < 0.03 THEN 0 WHEN dip IS NULL THEN 200 ELSE floor(least(greatest(10 ** dip, 50), 1000)) END::BIGINT AS distance,
  CASE WHEN n < 1000 THEN 'too_few_gaps' WHEN short < 0.03 THEN 'no_short_gap_peak' WHEN dip IS NULL THEN 'fallback' ELSE 'antimode' END AS mode
FROM (SELECT count(*) AS n, avg((gap < 300)::INT) AS short FROM (SELECT gap // 500 + 1 AS gap FROM gaps WHERE gap < 1000000)),
  (SELECT (SELECT centre FROM sm WHERE bin > a AND bin < b ORDER BY smooth, bin LIMIT 1) AS dip FROM (SELECT
    (SELECT bin FROM sm WHERE centre < log10(300) ORDER BY smooth DESC, bin LIMIT 1) AS a,
    (SELECT bin FROM sm WHERE centre > log10(300) AND centre < log10(5000) ORDER BY smooth DESC, bin LIMIT 1) AS b))""", _HIST)
def collapse_distance(t):
    distance, info = events.collapse_distance(events.pooled_gaps(t.events()).selectExpr("gap div 500 + 1 as gap"), 1000)
    return t.spark.createDataFrame([(distance, info["mode"])], "distance long, mode string")


@_query(f"SELECT seq, cell, h, p FROM (SELECT *, row_number() OVER (PARTITION BY cell, h, p // {GRAPH} ORDER BY seq) AS r FROM ev) WHERE r = 1")
def collapse_events(t):
    return events.collapse(t.events(), t.chroms(), GRAPH).select("seq", "cell", "h", "p")


@_query("SELECT cell, count(*) AS n, round(log10(greatest(count(*), 1)), 6) AS log_depth FROM ev GROUP BY cell")
def depth_per_cell(t):
    return events.depth(t.events()).select("cell", "n", *_six("log_depth"))


@_query("SELECT h, bin, n FROM us")
def pooled_coverage_usable_bins(t):
    return t.usable()


@_query("SELECT cell, n_events, n_bins, round(breadth, 6) AS breadth FROM bd")
def breadth_per_cell(t):
    return events.breadth(t.events(), t.chroms(), RT, t.usable()).select("cell", "n_events", "n_bins", *_six("breadth"))


@_query("SELECT cell, round(sum(am.value) / count(*), 6) AS cell_anchor FROM eb JOIN us USING (h, bin) JOIN am USING (h, bin) GROUP BY cell")
def cell_anchor(t):
    rows = events.cell_anchor(t.events(), t.chroms(), RT, t.usable(), intervals.bin_means(t.chroms(), t.anchor(), RT))
    return rows.select("cell", *_six("cell_anchor"))


_MAD = "CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad WHEN sd > 0 THEN sd ELSE 1e-9 END"


@_query(f"SELECT h, round(med, 6) AS med, round({_MAD}, 6) AS scale FROM (SELECT h, med, sd, median(abs(value - med)) AS mad FROM ev JOIN (SELECT h, median(value) AS med, stddev_pop(value) AS sd FROM ev GROUP BY h) USING (h) GROUP BY h, med, sd)")
def robust_mad(t):
    return stats.robust_mad(t.events(), "value", ["h"]).select("h", *_six("med", "scale"))


@_query("SELECT round(quantile_cont(value, 0.05), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.95), 6) AS q2, round(quantile_cont(value, 0.999), 6) AS q3 FROM ev")
def quantile_exact(t):
    return stats.quantiles(t.events(), "value", [0.05, 0.5, 0.95, 0.999]).select(*_six("q0", "q1", "q2", "q3"))


_GATES = gates.Gates(min_fragments=20, depth_low=0.05, depth_high=0.95, hard_floor=0.18, min_floor=0.20, breadth_max=0.36, min_events=20, min_signal=0.3)
_QC = f"""cl AS (SELECT pc.cell, pc.n, log10(greatest(pc.n, 1)) AS ld, coalesce(breadth, 0) AS breadth, coalesce(n_events, 0) AS n_signal, coalesce(n_events, 0) / pc.n::DOUBLE AS fs FROM pc LEFT JOIN bd ON bd.cell = pc.cell),
dq AS (SELECT quantile_cont(ld, 0.05) AS lo, quantile_cont(ld, 0.95) AS hi FROM cl),
ok AS (SELECT cl.*, ld >= lo AND ld <= hi AND n >= 20 AS d FROM cl, dq),
inn AS (SELECT *, breadth >= 0.18 AND breadth < 0.36 AND d AS i, count(*) FILTER (breadth >= 0.18 AND breadth < 0.36 AND d) OVER () AS c FROM ok),
pl AS (SELECT breadth FROM inn WHERE CASE WHEN c >= 50 THEN i ELSE breadth > 0 END),
pm AS (SELECT median(breadth) AS med, stddev_pop(breadth) AS sd FROM pl),
cut AS (SELECT greatest(0.2, med - 3 * {_MAD}) AS cut FROM (SELECT med, sd, median(abs(breadth - med)) AS mad FROM pl, pm GROUP BY med, sd)),
qc AS (SELECT cell, n, breadth, CASE WHEN breadth >= 0.36 THEN 'BREADTH_OVERSAT_FAIL' WHEN breadth < 0.18 THEN 'QC_FAIL_EMPTY' WHEN breadth < cut THEN 'BREADTH_SPARSE_FAIL'
  WHEN NOT d THEN 'DEPTH_FAIL' WHEN n_signal < 20 THEN 'LOW_EVENTS_FAIL' WHEN fs < 0.3 THEN 'DISPERSED_FAIL' ELSE 'PASS' END AS status FROM ok, cut)"""


def _status(t: Tables) -> DataFrame:
    raw = t.events()
    cells = events.depth(raw).join(events.breadth(raw, t.chroms(), RT, t.usable()), "cell", "left")
    cells = cells.select("cell", "n", "log_depth", F.coalesce("breadth", F.lit(0.0)).alias("breadth"), F.coalesce("n_events", F.lit(0)).alias("n_signal"))
    # A row per cell, which the thresholds read several times.
    return gates.status(settled(cells.withColumn("frac_signal", F.col("n_signal") / F.col("n"))), _GATES)


@_query("SELECT cell, n, round(breadth, 6) AS breadth, status FROM qc", _QC)
def qc_status(t):
    return _status(t).select("cell", "n", *_six("breadth"), "status")


@_query(f"SELECT s.status, coalesce(c.n, 0) AS n FROM (SELECT unnest([{', '.join(repr(s) for s in gates.REASONS)}]) AS status) s LEFT JOIN (SELECT status, count(*) AS n FROM qc GROUP BY status) c ON c.status = s.status", _QC)
def qc_status_counts(t):
    return gates.status_counts(_status(t))


_MIX = foreground.Mixture(10.5, 12.4, 1.1, 0.8, 0.35)


def _dens(x: str) -> tuple[str, str]:
    return tuple(f"exp(-0.5::DOUBLE * (({x} - {m}::DOUBLE) / {s}::DOUBLE) ** 2) / {s}::DOUBLE" for m, s in ((_MIX.mean1, _MIX.sd1), (_MIX.mean2, _MIX.sd2)))


_D1, _D2 = _dens("ln(gap)")


@_query(f"""SELECT count(*) AS n, round(sum(r), 6) AS n1, round(sum(r * x) / sum(r), 6) AS m1, round(sum((1 - r) * x) / sum(1 - r), 6) AS m2,
  round(sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) ** 2, 6) AS v1, round(sum((1 - r) * x * x) / sum(1 - r) - (sum((1 - r) * x) / sum(1 - r)) ** 2, 6) AS v2
FROM (SELECT ln(gap) AS x, 0.35::DOUBLE * {_D1} / (0.35::DOUBLE * {_D1} + 0.65::DOUBLE * {_D2}) AS r FROM gaps WHERE gap IS NOT NULL)""")
def mixture_em_step(t):
    values = events.adjacent_gaps(t.events()).where("gap is not null").groupBy("gap").agg(F.count("*").alias("c")).select(F.log(F.col("gap").cast("double")).alias("x"), "c")
    return foreground.mixture_step(values, _MIX).select("n", *_six("n1", "m1", "m2", "v1", "v2"))


def _density_sql(mean: str, sd: str) -> str:
    return f"exp(-0.5::DOUBLE * ((x - {mean}) / {sd}) ** 2) / {sd}"


@_query(f"""SELECT round(m1, 4) AS mean1, round(m2, 4) AS mean2, round(s1, 4) AS sd1, round(s2, 4) AS sd2, round(w, 4) AS weight FROM fit ORDER BY k DESC LIMIT 1""",
  f"""lx AS (SELECT ln(gap) AS x, count(*) AS c FROM gaps WHERE gap IS NOT NULL GROUP BY gap),
st AS (SELECT quantile_cont(ln(gap), 0.25) AS q1, quantile_cont(ln(gap), 0.75) AS q3, greatest(stddev_pop(ln(gap)), 0.2) AS sp, count(*) AS n FROM gaps WHERE gap IS NOT NULL),
fit(k, m1, m2, s1, s2, w, moved) AS (
  SELECT 0, q1, q3, greatest(0.6::DOUBLE * sp, 0.1::DOUBLE), greatest(0.8::DOUBLE * sp, 0.1::DOUBLE), 0.6::DOUBLE, 1.0::DOUBLE FROM st
  UNION ALL
  SELECT k + 1, b1, b2, d1, d2, v, greatest(abs(b1 - m1), abs(b2 - m2), abs(v - w)) FROM (
    SELECT k, m1, m2, w, least(a1, a2) AS b1, greatest(a1, a2) AS b2, CASE WHEN a1 <= a2 THEN e1 ELSE e2 END AS d1, CASE WHEN a1 <= a2 THEN e2 ELSE e1 END AS d2, CASE WHEN a1 <= a2 THEN u ELSE 1 - u END AS v FROM (
      SELECT k, m1, m2, w, x1 / n1 AS a1, x2 / n2 AS a2, greatest(sqrt(greatest(y1 / n1 - (x1 / n1) ** 2, 0.01::DOUBLE)), 0.1::DOUBLE) AS e1, greatest(sqrt(greatest(y2 / n2 - (x2 / n2) ** 2, 0.01::DOUBLE)), 0.1::DOUBLE) AS e2,
        least(greatest(n1 / (n1 + n2), 0.02::DOUBLE), 0.98::DOUBLE) AS u FROM (
        SELECT k, m1, m2, w, sum(c * r) AS n1, sum(c * (1 - r)) AS n2, sum(c * r * x) AS x1, sum(c * (1 - r) * x) AS x2, sum(c * r * x * x) AS y1, sum(c * (1 - r) * x * x) AS y2 FROM (
          SELECT fit.*, x, c, w * {_density_sql("m1", "s1")} / greatest(w * {_density_sql("m1", "s1")} + (1 - w) * {_density_sql("m2", "s2")}, 1e-300::DOUBLE) AS r FROM fit, lx WHERE k < 200 AND moved >= 1e-7)
        GROUP BY k, m1, m2, w) WHERE n1 >= 5 AND n2 >= 5)))""")
def mixture_fit(t):
    """The whole fit of the mixture to the gaps of all cells."""
    m = foreground.fit_mixture(events.adjacent_gaps(t.events()).where("gap is not null"))
    return t.spark.createDataFrame([dataclasses.astuple(m)] if m else [], "mean1 double, mean2 double, sd1 double, sd2 double, weight double").select(*[F.round(c, 4).alias(c) for c in ("mean1", "mean2", "sd1", "sd2", "weight")])


def _weights_sql(steps: int) -> str:
    out = [f"g0 AS (SELECT cell, {_D1} AS a, {_D2} AS b FROM gaps WHERE gap IS NOT NULL), w0 AS (SELECT cell, count(*) AS n, 0.35::DOUBLE AS w FROM g0 GROUP BY cell)"]
    for k in range(steps):
        out.append(f"""w{k + 1} AS (SELECT w.cell, w.n, greatest(0.01, least(0.99, w.n / (w.n + 60.0::DOUBLE) * (sum(w.w * a / greatest(w.w * a + (1 - w.w) * b, 1e-300)) / w.n) + (1 - w.n / (w.n + 60.0::DOUBLE)) * 0.35::DOUBLE)) AS w
  FROM w{k} w JOIN g0 ON g0.cell = w.cell GROUP BY w.cell, w.n, w.w)""")
    out.append(f"""own AS (SELECT gaps.*, CASE WHEN gap IS NULL THEN 0.0::DOUBLE ELSE w * {_D1} / greatest(w * {_D1} + (1 - w) * {_D2}, 1e-300) END AS q FROM gaps LEFT JOIN w{steps} w ON w.cell = gaps.cell),
post AS (SELECT seq, cell, greatest(q, coalesce(lead(q) OVER (PARTITION BY cell, h ORDER BY p, seq), 0)) AS posterior FROM own),
fg AS (SELECT post.*, posterior > 0.5 OR (s < 10 AND c >= 10) AS foreground FROM post JOIN (SELECT cell, count(*) FILTER (posterior > 0.5) AS s, count(*) AS c FROM post GROUP BY cell) k ON k.cell = post.cell)""")
    return ",\n".join(out)


@_query("SELECT seq, cell, round(posterior, 6) AS posterior, foreground FROM fg", _weights_sql(4))
def foreground_events(t):
    return foreground.foreground(t.events(), _MIX, min_events=10, iterations=4).select("seq", "cell", *_six("posterior"), "foreground")


@_query("SELECT cell, count(*) AS n_events, count(*) FILTER (foreground) AS n_signal, round((count(*) FILTER (foreground)) / count(*)::DOUBLE, 6) AS frac_signal FROM fg GROUP BY cell", _weights_sql(4))
def signal_fraction(t):
    return foreground.signal_fraction(foreground.foreground(t.events(), _MIX, min_events=10, iterations=4)).select("cell", "n_events", "n_signal", *_six("frac_signal"))


@_query("SELECT cell, h, col FROM occ")
def occupancy_binary(t):
    return t.occupancy()


@_query("SELECT cell, count(*) AS support FROM occ GROUP BY cell")
def support_per_cell(t):
    return matrix.support(t.occupancy())


@_query("SELECT DISTINCT cell, o.h, unnest(range(greatest(f, o.col - 2), least(l, o.col + 2) + 1)) AS col FROM occ o JOIN cols ON cols.col = o.col")
def dilate_bins(t):
    return matrix.dilate(t.occupancy(), t.columns(), 2)


@_query("SELECT col, block, nb.nb AS n_bins FROM bk JOIN nb USING (block)")
def block_assignment(t):
    return t.blocks()


@_query("SELECT cell, count(*) FILTER (m > 0) AS valid_blocks, sum(m)::BIGINT AS info_weight FROM (SELECT cell, least(count(*), nb - count(*)) AS m FROM occ JOIN bk USING (col) JOIN nb USING (block) GROUP BY cell, block, nb) GROUP BY cell")
def block_information(t):
    return matrix.information(t.occupancy(), t.blocks())


@_query("SELECT block, i, j, round(phi, 6) AS phi, w FROM ph", phi_sql("occ"))
def phi_block(t):
    return similarity.pair_phi(t.occupancy(), t.blocks(), by_block=True).select("block", "i", "j", *_six("phi"), "w")


@_query("SELECT i, j, round(phi, 6) AS phi FROM pp", phi_sql("occ"))
def phi_combined(t):
    return similarity.pair_phi(t.occupancy(), t.blocks()).select("i", "j", *_six("phi"))


@_query("SELECT i, j, r FROM bw WHERE r <= 10", phi_sql("occ"))
def topk_neighbours(t):
    return similarity.neighbours(similarity.nearest(t.occupancy(), t.blocks(), 10)).select("i", "j", F.col("r").cast("long").alias("r"))


@_query("SELECT least(i, j) AS a, greatest(i, j) AS b, round(sum((10 - r + 1) / 20.0::DOUBLE), 6) AS w FROM bw WHERE r <= 10 GROUP BY 1, 2", phi_sql("occ"))
def rank_affinity_edges(t):
    return similarity.affinity_edges(similarity.neighbours(similarity.nearest(t.occupancy(), t.blocks(), 10)), 10).select("a", "b", *_six("w"))


@_query("SELECT i, round(avg(phi) FILTER (r <= 10) - avg(phi), 6) AS contrast FROM bw GROUP BY i", phi_sql("occ"))
def neighbour_contrast(t):
    return similarity.nearest(t.occupancy(), t.blocks(), 10).select("i", *_six("contrast"))


_SHIFT = "sh AS (SELECT cell, o.h, f + (((o.col - f - (cell * 7919 + o.h * 104729 + 1299709)) % len) + len) % len AS col FROM occ o JOIN cols ON cols.col = o.col)"


@_query("SELECT cell, h, col FROM sh", _SHIFT)
def circular_shift(t):
    return matrix.circular_shift(t.occupancy(), t.columns(), 1)


@_query("SELECT i, round(avg(phi) FILTER (r <= 10) - avg(phi), 6) AS contrast FROM bw GROUP BY i", _SHIFT, phi_sql("sh"))
def circular_shift_null(t):
    shifted = matrix.circular_shift(t.occupancy(), t.columns(), 1)
    return similarity.nearest(shifted, t.blocks(), 10).select("i", *_six("contrast"))


_BASE = f"""rk AS (SELECT v AS y, log10(n) AS x, row_number() OVER (ORDER BY log10(n), v) - 1 AS r, count(*) OVER () AS c FROM pc),
bb AS (SELECT *, least(nb, 20) AS bins FROM (SELECT *, greatest(3, least(20, c // 25)) AS nb FROM rk)),
bi AS (SELECT *, least(bins - 1, ((r + 1) * bins - 1) // c) AS b FROM bb),
md AS (SELECT b, median(y) AS med, stddev_pop(y) AS sd, median(x) AS centre FROM bi GROUP BY b HAVING count(*) >= 5),
kn AS (SELECT centre, med AS mean, {_MAD} AS sd FROM (SELECT md.b, centre, med, sd, median(abs(y - med)) AS mad FROM bi JOIN md ON md.b = bi.b GROUP BY md.b, centre, med, sd)),
wh AS (SELECT med AS mean, {_MAD} AS sd FROM (SELECT med, sd, median(abs(y - med)) AS mad FROM rk, (SELECT median(y) AS med, stddev_pop(y) AS sd FROM rk) GROUP BY med, sd)),
kk2 AS (SELECT * FROM kn WHERE (SELECT count(*) FROM kn) >= 2 AND (SELECT count(*) FROM rk) >= 75 UNION ALL SELECT 0.0, mean, sd FROM wh WHERE (SELECT count(*) FROM kn) < 2 OR (SELECT count(*) FROM rk) < 75),
sg AS (SELECT *, lead(centre) OVER (ORDER BY centre) AS c2, lead(mean) OVER (ORDER BY centre) AS m2, lead(sd) OVER (ORDER BY centre) AS s2 FROM kk2)"""


@_query("""SELECT pc.cell, round(CASE WHEN sg.centre IS NULL THEN (SELECT mean FROM kk2 ORDER BY centre LIMIT 1) WHEN c2 IS NULL THEN mean ELSE mean + (log10(n) - sg.centre) / (c2 - sg.centre) * (m2 - mean) END, 6) AS null_mean,
  round(greatest(1e-9, CASE WHEN sg.centre IS NULL THEN (SELECT sd FROM kk2 ORDER BY centre LIMIT 1) WHEN c2 IS NULL THEN sd ELSE sd + (log10(n) - sg.centre) / (c2 - sg.centre) * (s2 - sd) END), 6) AS null_sd
FROM pc LEFT JOIN sg ON log10(n) >= sg.centre AND (c2 IS NULL OR log10(n) < c2)""", _BASE)
def binned_baseline(t):
    cells = t.per_cell()
    return stats.along_baseline(cells, "n", stats.binned_baseline(cells, "v", "n")).select("cell", *_six("null_mean", "null_sd"))


_LAND = """su AS (SELECT cell, count(*) AS support FROM occ GROUP BY cell),
lm AS (SELECT cell, support FROM (SELECT *, row_number() OVER (ORDER BY support, cell) - 1 AS r, count(*) OVER () AS n FROM su) x
  WHERE n <= 40 OR r IN (SELECT round_even(k * ((SELECT count(*) FROM su) - 1) / 39.0::DOUBLE, 0)::BIGINT FROM (SELECT unnest(range(40)) AS k)))"""


@_query("SELECT cell, support FROM lm", _LAND)
def landmark_pick(t):
    return matrix.pick_landmarks(matrix.support(t.occupancy()), 40)


def _cross(t: Tables) -> tuple[DataFrame, DataFrame]:
    occ = t.occupancy()
    marks = matrix.pick_landmarks(matrix.support(occ), 40)
    return similarity.cross_phi(occ, occ.join(marks, "cell", "left_semi"), t.blocks()), marks


_CROSS = "cx AS (SELECT i AS cell, j AS landmark, phi FROM bw WHERE j IN (SELECT cell FROM lm))"


@_query("SELECT cell, landmark, round(phi, 6) AS phi FROM cx", phi_sql("occ"), _LAND, _CROSS)
def landmark_phi(t):
    return _cross(t)[0].select("cell", "landmark", *_six("phi"))


@_query("""SELECT cell, round(sum((smooth - low + 1e-6::DOUBLE) * t) / sum(smooth - low + 1e-6::DOUBLE), 6) AS centre FROM (
  SELECT *, min(smooth) OVER (PARTITION BY cell) AS low FROM (
    SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(smooth, 9) DESC, landmark) AS r FROM mm WHERE smooth IS NOT NULL) WHERE r <= 10) GROUP BY cell""",
  phi_sql("occ"), _LAND, _CROSS, """tt AS (SELECT cell AS landmark, (row_number() OVER (ORDER BY support, cell) - 0.5::DOUBLE) / count(*) OVER () AS t FROM lm),
mm AS (SELECT g.cell, g.landmark, t, avg(phi) OVER (PARTITION BY g.cell ORDER BY t, g.landmark ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth
  FROM (SELECT * FROM (SELECT DISTINCT cell FROM cx), tt) g LEFT JOIN cx ON cx.cell = g.cell AND cx.landmark = g.landmark)""")
def moving_mean_centroid(t):
    cross, marks = _cross(t)
    places = timing.total_order(marks, ["support", "cell"], "t").select(F.col("cell").alias("landmark"), "t")
    return extension.centroids(extension.smoothed(cross, places, 2), "smooth", 10).select("cell", *_six("centre"))


_QQ = """qa AS (SELECT n::DOUBLE AS x, row_number() OVER (ORDER BY n) AS r FROM pc), qb AS (SELECT v AS y, row_number() OVER (ORDER BY v) AS r FROM pc),
kx AS (SELECT x, avg(y) AS y FROM qa JOIN qb USING (r) GROUP BY x),
ks AS (SELECT *, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS c FROM kx)"""


@_query("""SELECT q.cell, round(CASE WHEN (SELECT count(*) FROM pc) < 20 THEN q.q ELSE y + CASE WHEN c = 1 THEN 0 ELSE (y2 - y) / (x2 - x) END * (q.q - x) END, 6) AS mapped
FROM (SELECT cell, n * 1.25::DOUBLE - 10 AS q FROM pc) q LEFT JOIN ks ON (x2 IS NOT NULL OR c = 1) AND (k = 1 OR q.q >= x) AND (k >= c - 1 OR q.q < x2)""", _QQ)
def quantile_map(t):
    cells = t.per_cell()
    return stats.quantile_map(cells, "n", "v", cells.select("cell", (F.col("n") * 1.25 - 10).alias("q")), "q").select("cell", *_six("mapped"))


def _replicates(t: Tables) -> DataFrame:
    return t.events().groupBy("cell", F.expr("cast(seq % 8 as int)").alias("rep")).agg(F.round(F.avg("value"), 6).alias("x"))


_REPS = "rp AS (SELECT cell, (seq % 8)::INT AS rep, round(avg(value), 6) AS x FROM ev GROUP BY 1, 2)"


def _knots(x: str, y: str, rows: str) -> str:
    """Knots by rep of ``rows`` (rep, x, y), as qa, qb and ks of ``quantile_map`` have them."""
    return f"""ra AS (SELECT rep, {x} AS x, row_number() OVER (PARTITION BY rep ORDER BY {x}) AS r, count(*) OVER (PARTITION BY rep) AS pairs FROM {rows}), rb AS (SELECT rep, {y} AS y, row_number() OVER (PARTITION BY rep ORDER BY {y}) AS r FROM {rows}),
rx AS (SELECT rep, x, avg(y) AS y, max(pairs) AS pairs FROM ra JOIN rb USING (rep, r) GROUP BY rep, x),
rs AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS k, count(*) OVER (PARTITION BY rep) AS c FROM rx WINDOW w AS (PARTITION BY rep ORDER BY x))"""


def _mapped(least: int) -> str:
    return f"""mq AS (SELECT q.rep, q.cell, CASE WHEN pairs IS NULL OR pairs < {least} THEN q.q ELSE y + CASE WHEN c = 1 THEN 0 ELSE (y2 - y) / greatest(x2 - rs.x, 1e-12::DOUBLE) END * (q.q - rs.x) END AS p
FROM q LEFT JOIN rs ON rs.rep = q.rep AND (x2 IS NOT NULL OR c = 1) AND (k = 1 OR q.q >= rs.x) AND (k >= c - 1 OR q.q < x2))"""


@_query("SELECT rep, cell, round(p, 5) AS coord FROM mq", _REPS, "pv AS (SELECT rp.rep, rp.cell, x, v FROM rp JOIN pc USING (cell))", _knots("x", "v", "pv"), "q AS (SELECT rep, cell, x * 1.02::DOUBLE AS q FROM rp)", _mapped(20))
def replicate_calibration(t):
    """Values of each replicate mapped to the scale of the whole, every replicate with knots of its own."""
    reps = _replicates(t)
    asked = reps.select("rep", "cell", (F.col("x") * 1.02).alias("hat"))
    found = stats.quantile_map(reps.join(t.per_cell(), "cell"), "x", "v", asked, "hat", "coord", keys=["rep"])
    return found.select("rep", "cell", F.round("coord", 5).alias("coord"))


@_query("SELECT cell, count(p) AS n_used, round(stddev_pop(p), 5) AS sd, round(quantile_cont(p, 0.1), 5) AS lo10, round(quantile_cont(p, 0.9), 5) AS hi90 FROM mq GROUP BY cell",
  _REPS, "pr AS (SELECT cell, v, (row_number() OVER (ORDER BY n, v, cell) - 0.5::DOUBLE) / count(*) OVER () AS y FROM pc)", "pv AS (SELECT rep, v, y FROM pr, (SELECT DISTINCT rep FROM rp))", _knots("v", "y", "pv"), "q AS (SELECT rep, cell, x AS q FROM rp)", _mapped(5))
def bootstrap_final_scale(t):
    """The spread of each cell's replicates once they are on the scale of the final order."""
    reps = _replicates(t)
    order = timing.total_order(t.per_cell(), ["n", "v", "cell"])
    knots = order.select("v", "progression", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("rep"))
    mapped = stats.quantile_map(knots, "v", "progression", reps, "x", "p", 5, keys=["rep"])
    return stats.reduce_replicates(mapped, "cell", "p").select("cell", "n_used", *[F.round(c, 5).alias(c) for c in ("sd", "lo10", "hi90")])


@_query("""SELECT rho > 0 AS flipped, round(rho, 6) AS rho FROM (SELECT corr(a, b) AS rho FROM (
  SELECT rank() OVER (ORDER BY x) AS a, rank() OVER (ORDER BY ca) + (count(*) OVER (PARTITION BY ca) - 1) / 2.0::DOUBLE AS b FROM (
    SELECT cell, row_number() OVER (ORDER BY n, v, cell) AS x FROM pc) JOIN (
    SELECT cell, round(sum(am.value) / count(*), 6) AS ca FROM eb JOIN us USING (h, bin) JOIN am USING (h, bin) GROUP BY cell) USING (cell)))""")
def anchor_orientation(t):
    """Whether the order is turned so that it runs from early to late, by its correlation with the anchor."""
    anchor = events.cell_anchor(t.events(), t.chroms(), RT, t.usable(), intervals.bin_means(t.chroms(), t.anchor(), RT)).select("cell", *_six("cell_anchor"))
    flip, rho = timing.orientation(_ordered(t).join(anchor, "cell"), "progression", "cell_anchor")
    return t.spark.createDataFrame([(flip, rho)], "flipped boolean, rho double").select("flipped", *_six("rho"))


@_query("""SELECT cell, CASE WHEN e < 0.01 OR e * n < 0.5 THEN 'NO_STRUCTURE_FAIL' WHEN coalesce(valid, 0) < 10 THEN 'LOW_INFO_FAIL' ELSE 'PASS' END AS status FROM (
  SELECT cell, n, round((v - 50) / 100, 6) AS e FROM pc) LEFT JOIN (
  SELECT cell, count(*) FILTER (m > 0) AS valid FROM (SELECT cell, least(count(*), nb - count(*)) AS m FROM occ JOIN bk USING (col) JOIN nb USING (block) GROUP BY cell, block, nb) GROUP BY cell) USING (cell)""")
def structure_gate(t):
    """The structure and information gates, in their order."""
    rows = t.per_cell().withColumn("excess", F.round((F.col("v") - 50) / 100, 6)).withColumn("z", F.col("excess") * F.col("n"))
    return gates.structure_status(rows.join(matrix.information(t.occupancy(), t.blocks()), "cell", "left"), 0.01, 0.5, 10).select("cell", "status")


@_query("""SELECT round(CASE WHEN count(*) >= 5 THEN corr(a, b) END, 6) AS rho, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS b FROM pc)""")
def spearman(t):
    return stats.spearman(t.per_cell(), "n", "v").select(*_six("rho"), "n")


@_query("SELECT cell, round((row_number() OVER (ORDER BY v, cell) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE, 6) AS rank01 FROM pc")
def unit_rank(t):
    return stats.unit_rank(t.per_cell(), ["v", "cell"]).select("cell", *_six("rank01"))


@_query("SELECT cell, round((row_number() OVER (ORDER BY n, v, cell) - 0.5::DOUBLE) / count(*) OVER (), 6) AS progression, row_number() OVER (ORDER BY n, v, cell) AS global_order FROM pc")
def total_order(t):
    return timing.total_order(t.per_cell(), ["n", "v", "cell"]).select("cell", *_six("progression"), "global_order")


@_query("SELECT cell, ntile(16) OVER (ORDER BY n, v, cell)::INT AS pseudotime_bin FROM pc")
def ntile_bins(t):
    return timing.tiles(timing.total_order(t.per_cell(), ["n", "v", "cell"]), "global_order", 16).select("cell", "pseudotime_bin")


@_query("SELECT cell FROM qc WHERE status = 'PASS' EXCEPT SELECT cell FROM lm", _QC, _LAND)
def pending_except(t):
    return _status(t).where("status = 'PASS'").select("cell").exceptAll(matrix.pick_landmarks(matrix.support(t.occupancy()), 40).select("cell"))


@_query("SELECT cell FROM qc WHERE status = 'PASS' UNION SELECT cell FROM lm", _QC, _LAND)
def targets_union(t):
    return _status(t).where("status = 'PASS'").select("cell").union(matrix.pick_landmarks(matrix.support(t.occupancy()), 40).select("cell")).distinct()


def _track(t: Tables) -> DataFrame:
    order = timing.total_order(t.per_cell(), ["n", "v", "cell"])
    return timing.shrunk_means(matrix.cell_bins(t.events(), t.chroms(), RT), order, t.usable())


_RTSQL = """pr AS (SELECT cell, (row_number() OVER (ORDER BY n, v, cell) - 0.5::DOUBLE) / count(*) OVER () AS x FROM pc),
rt AS (SELECT us.h, us.bin, (coalesce(s, 0) + 3.0::DOUBLE * (SELECT avg(x) FROM pr)) / (coalesce(c, 0) + 3.0::DOUBLE) AS raw, coalesce(c, 0) AS support
  FROM us LEFT JOIN (SELECT h, bin, sum(x) AS s, count(*) AS c FROM (SELECT DISTINCT cell, h, bin FROM eb) JOIN pr USING (cell) GROUP BY h, bin) y ON y.h = us.h AND y.bin = us.bin)"""


@_query("SELECT h, bin, round(raw, 6) AS raw, support FROM rt", _RTSQL)
def inferred_rt_shrunk(t):
    return _track(t).select("h", "bin", *_six("raw"), "support")


@_query(f"SELECT h, bin, round(median(raw) OVER (PARTITION BY h ORDER BY bin * {RT} RANGE BETWEEN {2 * RT} PRECEDING AND {2 * RT} FOLLOWING), 6) AS smooth FROM rt", _RTSQL)
def inferred_rt_smoothed(t):
    return timing.running_median(_track(t), RT, 2 * RT).select("h", "bin", *_six("smooth"))


@_query(f'SELECT name AS chrom, bin * {RT} AS s, least((bin + 1) * {RT}, size) AS e, round(raw, 6) AS value FROM rt JOIN chroms USING (h) WHERE support > 0', _RTSQL)
def rt_bedgraph(t):
    return timing.bedgraph(_track(t), t.chroms(), RT, "raw").select("chrom", "s", "e", *_six("value"))


@_query("""SELECT cell, count(x) AS n_used, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.1), 6) AS lo10, round(quantile_cont(x, 0.9), 6) AS hi90
FROM (SELECT cell, seq % 8 AS rep, avg(value) AS x FROM ev GROUP BY cell, seq % 8) GROUP BY cell""")
def bootstrap_reduce(t):
    reps = t.events().groupBy("cell", F.expr("seq % 8").alias("rep")).agg(F.avg("value").alias("x"))
    return stats.reduce_replicates(reps, "cell", "x").select("cell", "n_used", *_six("sd", "lo10", "hi90"))


@_query("""SELECT cell, bin, n, round(ln(1 + n) / max(ln(1 + n)) OVER (PARTITION BY cell), 6) AS share FROM (
  SELECT cell, (p - 500000) // 50000 AS bin, count(*) AS n FROM ev WHERE h = 0 AND p >= 500000 AND p < 1500000 GROUP BY 1, 2)""")
def region_matrix(t):
    return matrix.region_counts(t.events(), 0, 500_000, 1_500_000, 50_000).select("cell", "bin", "n", *_six("share"))


_PR = "pr AS (SELECT cell, (row_number() OVER (ORDER BY n, v, cell) - 0.5::DOUBLE) / count(*) OVER () AS x FROM pc)"
_PD = "pd AS (SELECT abs(a.x - b.x) AS d, phi FROM pp JOIN pr a ON a.cell = i JOIN pr b ON b.cell = j WHERE phi IS NOT NULL)"


def _ordered(t: Tables) -> DataFrame:
    return timing.total_order(t.per_cell(), ["n", "v", "cell"])


@_query("SELECT least(floor(d * 40)::BIGINT, 39) AS bin, count(*) AS n, round(avg(phi), 6) AS phi FROM pd GROUP BY 1", phi_sql("occ"), _PR, _PD)
def similarity_decay(t):
    return report.similarity_decay(t.occupancy(), t.blocks(), _ordered(t)).select("bin", "n", *_six("phi"))


@_query("""SELECT round(CASE WHEN count(*) >= 50 THEN corr(a, b) END, 6) AS rho, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY near) + (count(*) OVER (PARTITION BY near) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS b
  FROM (SELECT -round(d, 9) AS near, round(phi, 9) AS p FROM pd))""", phi_sql("occ"), _PR, _PD)
def robinson_score(t):
    return report.robinson_score(t.occupancy(), t.blocks(), _ordered(t)).select(*_six("rho"), "n")


@_query("SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(50)) AS bin) b LEFT JOIN (SELECT least(floor((breadth - 0) / 1 * 50)::BIGINT, 49) AS bin, count(*) AS n FROM bd WHERE breadth BETWEEN 0 AND 1 GROUP BY 1) x ON x.bin = b.bin")
def breadth_histogram(t):
    return report.histogram(events.breadth(t.events(), t.chroms(), RT, t.usable()), "breadth", 0.0, 1.0, 50)


@_query("""SELECT name, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95
FROM (SELECT 'n' AS name, n::DOUBLE AS v FROM pc UNION ALL SELECT 'v', v FROM pc) GROUP BY name""")
def summary_percentiles(t):
    return report.percentiles(t.per_cell(), ["n", "v"]).select("name", *_six("p05", "median", "p95"))


@_query("""SELECT name, round(corr(a, b), 6) AS rho, count(*) AS n FROM (
  SELECT name, rank() OVER (PARTITION BY name ORDER BY x) AS a, rank() OVER (PARTITION BY name ORDER BY y) + (count(*) OVER (PARTITION BY name, y) - 1) / 2.0::DOUBLE AS b
  FROM (SELECT 'n' AS name, x, n::DOUBLE AS y FROM pr JOIN pc USING (cell) UNION ALL SELECT 'v', x, v FROM pr JOIN pc USING (cell))) GROUP BY name""", _PR)
def confounding_checks(t):
    return report.confounding(_ordered(t), "progression", ["n", "v"]).select("name", *_six("rho"), "n")


@_query("""SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY n, v, cell) - 1 AS r, count(*) OVER () AS c FROM pc)
WHERE c <= 50 OR r IN (SELECT round_even(k * ((SELECT count(*) FROM pc) - 1) / 49.0::DOUBLE, 0)::BIGINT FROM (SELECT unnest(range(50)) AS k))""")
def display_sample(t):
    return report.evenly_spaced(_ordered(t), "global_order", 50).select("cell")


_RUN = Config()


def _seriated(t: Tables) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """The dilated occupancy, that of the landmarks, the number of neighbours and all replicates, as a run has them by default."""
    occ = settled(matrix.dilate(t.occupancy(), t.columns(), 1))
    marks = settled(matrix.pick_landmarks(matrix.support(occ), _RUN.max_order_cells))
    own = settled(occ.join(marks, "cell", "left_semi"))
    k = seriation.neighbour_count(marks.count(), _RUN.knn)
    return occ, own, k, seriation.seriate_replicates(own, t.blocks(), k, _RUN.n_bootstrap, _RUN.refine_rounds, _RUN.seed)


@_query(None)
def landmark_seriation(t):
    """Orders of the landmarks under the base weights, split halves and bootstrap replicates."""
    return _seriated(t)[-1]


@_query(None)
def landmark_extension(t):
    """Places of all cells among the seriated landmarks, and among those of each replicate turned to their order."""
    occ, own, k, made = _seriated(t)
    made = settled(made)
    replicates, _ = seriation.aligned_replicates(made, _RUN.boot_min_abs_rho)
    coords = made.where(f"rep = {seriation.BASE} and coord is not null").select("cell", F.col("coord").alias("t"))
    return extension.place(occ, own, coords, replicates, t.blocks(), k)


_PLANTED = f"""pl AS (SELECT seq, cell // 5 AS cell, h, p, unnest(range({RT // GRAPH})) AS j, (cell // 5 * 7919 % 1009 + 0.5::DOUBLE) / 1009.0::DOUBLE AS t FROM ev),
po AS (SELECT DISTINCT cell, pl.h, col FROM pl JOIN cols ON pl.h = cols.h AND (p // {RT} * {RT} + (p + j * {GRAPH}) % {RT}) // {GRAPH} = cols.bin
  WHERE ((pl.h * {SIZE // RT} + p // {RT}) * 104729 % 1009) / 1009.0::DOUBLE < 0.1::DOUBLE + 0.8::DOUBLE * t OR seq % 100 < 3)"""


def _planted(t: Tables) -> DataFrame:
    return settled(matrix.occupancy(t.planted(), t.chroms(), GRAPH, t.columns()))


@_query("""SELECT rep, n AS cells, CASE WHEN n >= 20 THEN true END AS follows, CASE WHEN n >= 20 THEN true END AS halves_agree
FROM (SELECT count(DISTINCT cell) AS n FROM po), (SELECT unnest(range(-3, 0))::INT AS rep)""", _PLANTED)
def planted_seriation(t):
    """Whether the order by all blocks, and by each half of them, is that which was planted; and whether the halves run the same way once turned."""
    occ = _planted(t)
    k = seriation.neighbour_count(occ.select("cell").distinct().count(), _RUN.knn)
    made = settled(seriation.seriate_replicates(occ, t.blocks(), k, 0, _RUN.refine_rounds, _RUN.seed))
    _, split = seriation.halves(made)
    rows = made.withColumn("t", planted_place(F.col("cell")))
    rho = seriation.rank_correlations(rows.where("coord is not null"), "rep", "coord", "t")
    cells = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("cells")).join(rho, "rep", "left")
    return cells.select("rep", "cells", (F.abs("rho") >= 0.95).alias("follows"), F.lit(None if split is None else split >= 0.9).cast("boolean").alias("halves_agree"))


_AROUND = """pk AS (SELECT n, least(greatest(3, least(least(greatest(n // 25, 10), 50), greatest(3, n - 1))), greatest(1, n - 1)) AS k FROM (SELECT count(DISTINCT cell) AS n FROM po)),
ph2 AS (SELECT n, k, greatest(1, least(k // 3, greatest(1, n // 20))) AS half FROM pk),
pt AS (SELECT DISTINCT cell, (cell * 7919 % 1009 + 0.5::DOUBLE) / 1009.0::DOUBLE AS t FROM po),
pg AS (SELECT g.cell, g.landmark, g.t, b.phi, row_number() OVER (PARTITION BY g.cell ORDER BY g.t, g.landmark) AS o
  FROM (SELECT a.cell, l.cell AS landmark, l.t FROM pt a, pt l) g LEFT JOIN bw b ON b.i = g.cell AND b.j = g.landmark),
ps AS (SELECT pg.*, k, avg(pg.phi) OVER (PARTITION BY pg.cell ORDER BY o ROWS BETWEEN half PRECEDING AND half FOLLOWING) AS smooth FROM pg, ph2)"""


def _centre(value: str) -> str:
    return f"""(SELECT cell, sum(({value} - low + 1e-6::DOUBLE) * t) / sum({value} - low + 1e-6::DOUBLE) AS c FROM (SELECT *, min({value}) OVER (PARTITION BY cell) AS low FROM (
      SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {value} DESC, o) AS r FROM ps WHERE {value} IS NOT NULL) WHERE r <= k) GROUP BY cell)"""


@_query(f"""SELECT pt.cell, round(s.c, 6) AS hat, round(q.c, 6) AS secondary, round(1 - s.c, 6) AS turned FROM pt
LEFT JOIN {_centre("smooth")} s ON s.cell = pt.cell LEFT JOIN {_centre("phi")} q ON q.cell = pt.cell""", _PLANTED, phi_sql("po"), _AROUND)
def planted_extension(t):
    """Places of all cells among the others at their planted places, and under a replicate that runs the other way."""
    occ = _planted(t)
    marks = settled(occ.select("cell").distinct().withColumn("t", planted_place(F.col("cell"))))
    replicates = marks.select(F.lit(0).alias("rep"), "cell", (1 - F.col("t")).alias("coord"))
    k = seriation.neighbour_count(marks.count(), _RUN.knn)
    placed = extension.place(occ, occ, marks, replicates, t.blocks(), k)
    return placed.select("cell", *_six("hat", "secondary"), F.round(F.get("boot", F.lit(0)), 6).alias("turned"))
