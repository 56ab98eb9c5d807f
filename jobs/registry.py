"""The jobs as queries: each runs twice into one new folder and returns what is written after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cell_coverage, composition_track
from repliphase.functions.storage import shared_folder
from repliphase.plans.standin import PREFIX


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's counts by bin, with its totals and status."""
    base = _folder(spark, "job1")
    for _ in range(2):
        cells = cell_coverage.run(spark, sf_dir, f"{base}/out", f"{base}/checkpoint")
    cells = cells.select("cell", F.col("n").alias("cell_n"), F.col("blocked").alias("cell_blocked"), "n_bins", F.round("breadth", 6).alias("breadth"), "status")
    return cell_coverage.coverage(spark, f"{base}/out").join(cells, "cell")


def job2_composition_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window, and every interval of the mask as a row of its own."""
    base = _folder(spark, "job2")
    for _ in range(2):
        track, mask = composition_track.run(spark, sf_dir, base)
    none = {"known": F.lit(None).cast("long"), "value": F.lit(None).cast("double"), "odd": F.lit(True), "kind": F.lit("mask")}
    rows = track.withColumns({"kind": F.lit("window"), "value": F.round("value", 6)}).unionByName(mask.withColumns(none))
    return rows.select("kind", "doc_id", "source", "s", "e", "known", "value", "odd")


_MAD = "CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd ELSE 1e-9 END"

QUERIES = {"job1_cell_coverage": job1_cell_coverage, "job2_composition_track": job2_composition_track}

ORACLES = {
    "job1_cell_coverage": PREFIX + f""",
hit AS (SELECT cell, eb.h, bin, EXISTS (SELECT 1 FROM bm WHERE bm.h = eb.h AND bm.s <= eb.p AND eb.p < bm.e) AS hit FROM eb WHERE cell IS NOT NULL AND p IS NOT NULL AND seq IS NOT NULL),
cov AS (SELECT cell, h, bin, count(*) FILTER (NOT hit) AS n, count(*) FILTER (hit) AS blocked FROM hit GROUP BY cell, h, bin),
p2 AS (SELECT h, bin, sum(n + blocked) AS n FROM cov GROUP BY h, bin),
a2 AS (SELECT * FROM p2 WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.h = p2.h AND fr.bin = p2.bin AND fraction > 0.5)),
u2 AS (SELECT a2.* FROM a2, (SELECT quantile_cont(n, 0.01) AS q0, quantile_cont(n, 0.999) AS q1 FROM a2) WHERE n >= q0 - 1e-9 AND n <= q1 + 1e-9),
b2 AS (SELECT cell, sum(cov.n) AS n_signal, count(*) AS n_bins, count(*)::DOUBLE / (SELECT count(*) FROM u2) AS breadth FROM cov JOIN u2 USING (h, bin) WHERE cov.n > 0 GROUP BY cell),
c2 AS (SELECT d.cell, n, blocked, coalesce(n_bins, 0) AS n_bins, coalesce(breadth, 0) AS breadth, coalesce(n_signal, 0) AS n_signal, log10(greatest(n, 1)) AS ld
  FROM (SELECT cell, sum(n) AS n, sum(blocked) AS blocked FROM cov GROUP BY cell) d LEFT JOIN b2 ON b2.cell = d.cell),
dq AS (SELECT quantile_cont(ld, 0.05) AS lo, quantile_cont(ld, 0.95) AS hi FROM c2 WHERE n > 0),
ok AS (SELECT c2.*, ld >= lo AND ld <= hi AND n >= 20 AS d FROM c2, dq),
inn AS (SELECT *, breadth >= 0.18 AND breadth < 0.36 AND d AS i, count(*) FILTER (breadth >= 0.18 AND breadth < 0.36 AND d) OVER () AS c FROM ok WHERE n > 0),
pl AS (SELECT breadth FROM inn WHERE CASE WHEN c >= 50 THEN i ELSE breadth > 0 END),
pm AS (SELECT median(breadth) AS med, stddev_pop(breadth) AS sd FROM pl),
cut AS (SELECT greatest(0.2, med - 3 * {_MAD}) AS cut FROM (SELECT med, sd, median(abs(breadth - med)) AS mad FROM pl, pm GROUP BY med, sd)),
st AS (SELECT *, CASE WHEN n = 0 THEN 'NO_FRAGMENTS' WHEN breadth >= 0.36 THEN 'BREADTH_OVERSAT_FAIL' WHEN breadth < 0.18 THEN 'QC_FAIL_EMPTY' WHEN breadth < cut THEN 'BREADTH_SPARSE_FAIL'
  WHEN NOT d THEN 'DEPTH_FAIL' WHEN n_signal < 20 THEN 'LOW_EVENTS_FAIL' WHEN n_signal / n::DOUBLE < 0.3 THEN 'DISPERSED_FAIL' ELSE 'PASS' END AS status FROM ok, cut)
SELECT cov.cell, cov.h, cov.bin, cov.n, cov.blocked, st.n::BIGINT AS cell_n, st.blocked::BIGINT AS cell_blocked, n_bins, round(breadth, 6) AS breadth, status
FROM cov JOIN st ON st.cell = cov.cell""",
    "job2_composition_track": """
WITH d AS (SELECT source, doc_id, text, unnest(range((length(text) + 499) // 500)) * 500 AS s FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0),
w AS (SELECT source, doc_id, s, substr(text, s + 1, 500) AS x FROM d),
c AS (SELECT source, doc_id, s, max(s + length(x)) AS e, sum(length(regexp_replace(x, '[^A-Za-z]', '', 'g')))::BIGINT AS known, sum(length(regexp_replace(x, '[^GCgc]', '', 'g'))) AS hits FROM w GROUP BY source, doc_id, s),
t AS (SELECT *, hits / nullif(known, 0)::DOUBLE AS value FROM c),
o AS (SELECT *, known < 0.75::DOUBLE * (e - s) OR coalesce(value < 0.01::DOUBLE OR value > 0.06::DOUBLE, true) AS odd FROM t),
m AS (SELECT source, doc_id, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(first) OVER (PARTITION BY source, doc_id ORDER BY s) AS g FROM (
    SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY source, doc_id ORDER BY s) THEN 0 ELSE 1 END AS first FROM o WHERE odd)) GROUP BY source, doc_id, g)
SELECT 'window' AS kind, doc_id, source, s, e, known, round(value, 6) AS value, odd FROM o
UNION ALL SELECT 'mask', doc_id, source, s, e, NULL, NULL, true FROM m""",
}
