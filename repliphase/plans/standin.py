"""Genomic roles played by the supplied tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repliphase.functions.storage import settled
from repliphase.operators import events as ev_ops
from repliphase.operators import intervals, matrix

SIZE, RT, GRAPH = 2_592_000, 86_400, 21_600
#: How many suppliers' intervals have their full width in all.
WIDE, NARROW = 100, 34
NAMES = ("click", "error", "purchase", "signup", "view")


def planted_place(cell: Column) -> Column:
    """The place between 0 and 1 of a cell of ``Tables.planted``."""
    return (cell * 7919 % 1009 + F.lit(0.5)) / F.lit(1009.0)


def as_events(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (seq, cell, h, p, more...) of a table or stream of events."""
    h = "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"
    # Microseconds of a timestamp without zone, whatever the session's zone is.
    p = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000000"
    return rows.selectExpr("event_id as seq", "user_id as cell", f"{h} as h", f"{p} as p", *more)


def _once(make):
    """The method's rows, settled when first asked for and then kept with the object."""

    def kept(self):
        if make.__name__ not in self.kept:
            self.kept[make.__name__] = settled(make(self))
        return self.kept[make.__name__]

    return kept


class Tables:
    """The stand-in tables of one folder; what a query reads more than once is worked out once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.kept = spark, path, {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def chroms(self) -> DataFrame:
        return self.spark.createDataFrame([(k, n, SIZE) for k, n in enumerate(NAMES)], "h int, name string, size long")

    def events(self) -> DataFrame:
        return as_events(self.read("events"), "value")

    def planted(self) -> DataFrame:
        """Events of cells whose place is known: five users make a cell, and of its events those remain whose day fires before its place.

        Places of cells and days are congruences; three events in a hundred remain anyhow. Each counts in all four bins of its day,
        so that cells are as full as sequencing makes them.
        """
        fires = F.expr(f"((h * {SIZE // RT} + p div {RT}) * 104729 % 1009) / 1009D")
        rows = self.events().withColumn("cell", F.expr("cell div 5")).where((fires < 0.1 + 0.8 * planted_place(F.expr("cell"))) | (F.col("seq") % 100 < 3))
        return rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(RT // GRAPH - 1)))).withColumn("p", F.expr(f"p div {RT} * {RT} + (p + j * {GRAPH}) % {RT}")).drop("j")

    def blacklist(self, overlapping: bool = False) -> DataFrame:
        """An interval per supplier; widths shrink with their number, so that they cover the same share at any scale."""
        rows, s = self.read("supplier"), "(s_suppkey * 104729) % 2500000"
        width = f"greatest(1, (2000 + (s_suppkey % 7) * 25000) * {WIDE if overlapping else NARROW} div {max(1, rows.count())})"
        return rows.selectExpr("cast(s_suppkey % 5 as int) as h", f"{s} as s", f"{s} + {width} as e")

    @_once
    def merged(self) -> DataFrame:
        return intervals.merge(self.blacklist())

    def anchor(self) -> DataFrame:
        rows = self.events().withColumn("w", F.expr(f"p div {GRAPH}")).groupBy("h", "w").agg(F.round(F.avg("value"), 6).alias("value"))
        return rows.selectExpr("h", f"w * {GRAPH} as s", f"(w + 1) * {GRAPH} as e", "value")

    def sam(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber as seq", "concat(l_returnflag, l_linestatus) as chrom", "l_partkey as pos", "cast(l_quantity as int) as mapq",
            "case when l_linenumber = 6 then '*' else concat(cast(l_quantity as int), 'M', l_linenumber, 'D', l_suppkey, 'S') end as cigar",
            "array('NM:i:0', case when l_linenumber = 7 then 'CB:Z:-' else concat('CB:Z:', l_suppkey) end) as tags",
        )

    def barcodes(self) -> DataFrame:
        return self.read("customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as cell").distinct()

    @_once
    def usable(self) -> DataFrame:
        chroms = self.chroms()
        return ev_ops.usable_bins(self.events(), chroms, RT, intervals.bin_fraction(chroms, self.merged(), RT), intervals.bin_means(chroms, self.anchor(), RT))

    @_once
    def columns(self) -> DataFrame:
        chroms = self.chroms()
        return matrix.columns(chroms, GRAPH, intervals.bin_fraction(chroms, self.merged(), GRAPH))

    @_once
    def occupancy(self) -> DataFrame:
        return matrix.occupancy(self.events(), self.chroms(), GRAPH, self.columns())

    @_once
    def blocks(self) -> DataFrame:
        return matrix.blocks(self.columns(), 10, 12, 16)

    def per_cell(self) -> DataFrame:
        """Rows (cell, n, v): events and their mean, summed in order of ``seq``.

        A mean of 64 values with two decimals can lie half-way between two of six decimals; how it is rounded then hangs on the order of the sum.
        """
        own = Window.partitionBy("cell").orderBy("seq")
        so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.events().withColumns({"n": F.count("*").over(so_far), "v": F.round(F.avg("value").over(so_far), 6), "more": F.lead(F.lit(True)).over(own)})
        return rows.where("more is null").select("cell", "n", "v")


def _fractions(width: int) -> str:
    last = SIZE // width - 1
    return f"""SELECT h, bin, least(sum(ov) / {width}.0::DOUBLE, 1.0) AS fraction FROM (
      SELECT h, bin, greatest(0, least(e, (bin + 1) * {width}) - greatest(s, bin * {width})) AS ov FROM (
        SELECT h, s, e, unnest(range(least(s // {width}, {last}), least((e - 1) // {width}, {last}) + 1)) AS bin FROM bm)) GROUP BY h, bin HAVING sum(ov) > 0"""


def merged_sql(table: str) -> str:
    return f"""SELECT h, min(s) AS s, max(e) AS e FROM (
      SELECT *, sum(nw) OVER (PARTITION BY h ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY h ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {table})) GROUP BY h, g"""


def means_sql(width: int) -> str:
    last = -(-SIZE // width) - 1
    return f"""SELECT h, bin, sum(value * ov) / sum(ov) AS value FROM (
      SELECT h, value, bin, greatest(0, least(e, (bin + 1) * {width}) - greatest(s, bin * {width})) AS ov FROM (
        SELECT h, s, e, value, unnest(range(least(s // {width}, {last}), least((e - 1) // {width}, {last}) + 1)) AS bin FROM an)) GROUP BY h, bin HAVING sum(ov) > 0"""


_S = "(s_suppkey * 104729) % 2500000"


def _width(full: int) -> str:
    return f"greatest(1, (2000 + (s_suppkey % 7) * 25000) * {full} // (SELECT count(*) FROM supplier))"


_PAIR = "LEFT JOIN n11 ON n11.block = a.block AND n11.i = a.cell AND n11.j = b.cell"
PREFIX = f"""WITH RECURSIVE chroms AS (SELECT h, name, {SIZE}::BIGINT AS size FROM (VALUES {', '.join(f"({k}, '{n}')" for k, n in enumerate(NAMES))}) t(h, name)),
ev AS (SELECT event_id AS seq, user_id AS cell, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS h,
  (epoch_us(ts) - 1704067200000000) // 1000000 AS p, value FROM events),
bo AS (SELECT (s_suppkey % 5)::INT AS h, {_S} AS s, {_S} + {_width(WIDE)} AS e FROM supplier),
bl AS (SELECT (s_suppkey % 5)::INT AS h, {_S} AS s, {_S} + {_width(NARROW)} AS e FROM supplier),
bm AS ({merged_sql("bl")}),
an AS (SELECT h, w * {GRAPH} AS s, (w + 1) * {GRAPH} AS e, round(avg(value), 6) AS value FROM (SELECT h, p // {GRAPH} AS w, value FROM ev) GROUP BY h, w),
sam AS (SELECT l_orderkey * 10 + l_linenumber AS seq, concat(l_returnflag, l_linestatus) AS chrom, l_partkey AS pos, l_quantity::INT AS mapq,
  CASE WHEN l_linenumber = 6 THEN '*' ELSE concat(l_quantity::INT, 'M', l_linenumber, 'D', l_suppkey, 'S') END AS cigar,
  CASE WHEN l_linenumber = 7 THEN '-' ELSE l_suppkey::VARCHAR END AS tag FROM lineitem),
sf AS (SELECT seq, chrom, pos AS s, pos + list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: x::BIGINT)) - 1 AS e, tag AS barcode
  FROM sam WHERE cigar <> '*' AND tag <> '-' AND pos <> 0 AND mapq >= 10),
fr AS ({_fractions(RT)}), gf AS ({_fractions(GRAPH)}), am AS ({means_sql(RT)}),
eb AS (SELECT *, least(greatest(p // {RT}, 0), {SIZE // RT - 1}) AS bin, least(greatest(p // {GRAPH}, 0), {SIZE // GRAPH - 1}) AS gb FROM ev),
pool AS (SELECT h, bin, count(*) AS n FROM eb GROUP BY h, bin),
av AS (SELECT * FROM pool WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.h = pool.h AND fr.bin = pool.bin AND fraction > 0.5) AND EXISTS (SELECT 1 FROM am WHERE am.h = pool.h AND am.bin = pool.bin)),
us AS (SELECT av.* FROM av, (SELECT quantile_cont(n, 0.01) AS q0, quantile_cont(n, 0.999) AS q1 FROM av) WHERE n >= q0 - 1e-9 AND n <= q1 + 1e-9),
bd AS (SELECT cell, count(*) AS n_events, count(DISTINCT h * 1000 + eb.bin) AS n_bins, count(DISTINCT h * 1000 + eb.bin)::DOUBLE / (SELECT count(*) FROM us) AS breadth FROM eb JOIN us USING (h, bin) GROUP BY cell),
pc AS (SELECT cell, count(*) AS n, round(avg(value), 6) AS v FROM ev GROUP BY cell),
gaps AS (SELECT *, nullif(p - lag(p) OVER (PARTITION BY cell, h ORDER BY p, seq), 0) AS gap FROM ev),
cb AS (SELECT *, row_number() OVER (ORDER BY h, bin) - 1 AS col FROM (SELECT h, unnest(range({SIZE // GRAPH})) AS bin FROM chroms) c
  WHERE NOT EXISTS (SELECT 1 FROM gf WHERE gf.h = c.h AND gf.bin = c.bin AND fraction > 0.5)),
cols AS (SELECT *, min(col) OVER (PARTITION BY h) AS f, max(col) OVER (PARTITION BY h) AS l, count(*) OVER (PARTITION BY h) AS len FROM cb),
occ AS (SELECT DISTINCT cell, eb.h, col FROM eb JOIN cols ON eb.h = cols.h AND eb.gb = cols.bin),
bk AS (SELECT col, (h * 2 + CASE WHEN col - f >= len // 2 THEN 1 ELSE 0 END)::INT AS block FROM cols),
nb AS (SELECT block, count(*) AS nb FROM bk GROUP BY block)"""


def phi_sql(occ: str) -> str:
    """More expressions: kk (counts of every cell and block), ph (by block), pp (combined), bw (both ways with ranks)."""
    return f"""ob AS (SELECT DISTINCT o.cell, bk.block, o.col FROM {occ} o JOIN bk ON o.col = bk.col),
kk AS (SELECT c.cell, nb.block, nb.nb, coalesce(k, 0) AS k FROM (SELECT DISTINCT cell FROM {occ}) c CROSS JOIN nb LEFT JOIN (SELECT cell, block, count(*) AS k FROM ob GROUP BY cell, block) x ON x.cell = c.cell AND x.block = nb.block),
n11 AS (SELECT x.block, x.cell AS i, y.cell AS j, count(*) AS n FROM ob x JOIN ob y ON x.block = y.block AND x.col = y.col AND x.cell < y.cell GROUP BY ALL),
ph AS (SELECT a.block, a.cell AS i, b.cell AS j, least(least(a.k, a.nb - a.k), least(b.k, b.nb - b.k))::DOUBLE AS w,
  CASE WHEN a.k IN (0, a.nb) OR b.k IN (0, b.nb) THEN 0.0::DOUBLE ELSE greatest(-1, least(1, (coalesce(n11.n, 0) / a.nb::DOUBLE - a.k / a.nb::DOUBLE * (b.k / a.nb::DOUBLE))
    / sqrt(a.k / a.nb::DOUBLE * (1 - a.k / a.nb::DOUBLE) * (b.k / a.nb::DOUBLE * (1 - b.k / a.nb::DOUBLE))))) END AS phi
  FROM kk a JOIN kk b ON a.block = b.block AND a.cell < b.cell {_PAIR}),
pp AS (SELECT i, j, sum(w * phi) / nullif(sum(w), 0) AS phi FROM ph GROUP BY i, j),
bw AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(phi, 9) DESC, j) AS r FROM (SELECT i, j, phi FROM pp UNION ALL SELECT j, i, phi FROM pp) WHERE phi IS NOT NULL)"""
