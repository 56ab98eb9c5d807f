"""Both jobs: over growing input, after an interruption, and over odd rows; everything on copies."""

import datetime as dt
import json
import logging
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import cell_coverage, composition_track, registry
from jobs.common import load_config

DATA = Path("/root/testdata/sf0.001")
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables whose events come in four files, of which the first two are there."""
    folder = tmp_path / "tables"
    spark.read.parquet(f"{DATA}/supplier.parquet").write.parquet(f"{folder}/supplier.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").repartition(4, "event_id").write.parquet(str(tmp_path / "all"))
    files = sorted((tmp_path / "all").glob("part-*"))
    (folder / "events.parquet").mkdir()
    for f in files[:2]:
        f.rename(folder / "events.parquet" / f.name)
    return folder, files[2:]


def _cover(spark, folder, out, check):
    cells = cell_coverage.run(spark, str(folder), str(out), str(check))
    return _rows(cell_coverage.coverage(spark, str(out))), _rows(cells)


def test_two_runs_over_growing_events_equal_one(spark, tables, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs.cell_coverage")
    folder, later = tables
    first = _cover(spark, folder, tmp_path / "a", tmp_path / "ca")
    for f in later:
        f.rename(folder / "events.parquet" / f.name)
    read = lambda: sum(int(r.getMessage().split("read ")[1].split()[0]) for r in caplog.records if "batch" in r.getMessage())
    before = read()
    second = _cover(spark, folder, tmp_path / "a", tmp_path / "ca")
    total = spark.read.parquet(str(folder / "events.parquet")).count()
    assert 0 < before < total and read() == total  # the second run read the new files alone
    assert first != second
    again = _cover(spark, folder, tmp_path / "a", tmp_path / "ca")
    assert again == second and read() == total
    assert _cover(spark, folder, tmp_path / "b", tmp_path / "cb") == second
    assert sorted(p.name for p in (tmp_path / "a" / "parts").glob("batch=*")) == ["batch=0", "batch=1"]


def test_a_batch_that_was_cut_off_counts_once(spark, tables, tmp_path):
    folder, later = tables
    whole = _cover(spark, folder, tmp_path / "a", tmp_path / "c")
    # As if the driver had died after the batch was written and before it was committed.
    for f in (tmp_path / "c" / "commits").glob("*0*"):
        f.unlink()
    assert _cover(spark, folder, tmp_path / "a", tmp_path / "c") == whole


def test_the_first_mask_holds(spark, tables, tmp_path):
    folder, _ = tables
    whole = _cover(spark, folder, tmp_path / "a", tmp_path / "c")
    spark.read.parquet(f"{DATA}/supplier.parquet").limit(1).write.mode("overwrite").parquet(f"{folder}/supplier.parquet")
    assert _cover(spark, folder, tmp_path / "a", tmp_path / "c") == whole


def test_odd_events(spark, tmp_path):
    folder, day = tmp_path / "t", dt.datetime(2024, 1, 2)
    rows = [(1, day, 5, "click", 1.0, ""), (1, day, 5, "click", 1.0, ""), (None, day, 5, "click", 1.0, ""), (2, None, 5, "view", 1.0, ""), (3, day, None, "view", 1.0, "")]
    rows += [(4, day, 6, None, None, None), (5, dt.datetime(2019, 1, 1), 6, "error", 1.0, ""), (6, dt.datetime(2034, 1, 1), 6, "error", 1.0, "")]
    spark.createDataFrame(rows, EVENTS).withColumns({"n": F.lit("x"), "hit": F.lit(1)}).write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{DATA}/supplier.parquet").limit(0).write.parquet(f"{folder}/supplier.parquet")
    cover, cells = _cover(spark, folder, tmp_path / "a", tmp_path / "c")
    # bin, blocked, cell, h, n: a repeated row counts as it stands, times outside fall into the end bins, an unknown kind is the last.
    assert cover == [(0, 0, 6, 1, 1), (1, 0, 5, 0, 2), (1, 0, 6, 4, 1), (29, 0, 6, 1, 1)]
    assert sorted((c[2], c[3]) for c in cells) == [(5, 2), (6, 3)]


def test_no_events_and_then_some(spark, tables, tmp_path):
    folder, _ = tables
    held = list((folder / "events.parquet").iterdir())
    for f in held:
        f.rename(tmp_path / f.name)
    assert _cover(spark, folder, tmp_path / "a", tmp_path / "c") == ([], [])
    for f in held:
        (tmp_path / f.name).rename(f)
    assert _cover(spark, folder, tmp_path / "a", tmp_path / "c") == _cover(spark, folder, tmp_path / "b", tmp_path / "d")


DOCS = "doc_id long, text string, lang string, source string, n_chars long, s long, odd string"


def _track(spark, rows, tmp_path, name="o", **config):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/{name}-t/documents.parquet")
    return composition_track.run(spark, f"{tmp_path}/{name}-t", f"{tmp_path}/{name}", load_config("composition_track") | config)


def test_windows_and_mask(spark, tmp_path):
    text = "GCAA" * 5 + "....." * 4 + "TTTT" * 5 + "gAA"
    rows = [(1, text, "en", s, 0, 0, "x") for s in ("a", None, "", "=", "none", "a/b")]
    rows += [(1, "GGGG", "en", "a", 0, 0, "x"), (2, "", "en", "a", 0, 0, "x"), (3, None, "en", "a", 0, 0, "x"), (None, "GCGC", "en", "a", 0, 0, "x"), (4, "é" * 25, "en", "a", 0, 0, "x")]
    track, mask = _track(spark, rows, tmp_path, width=20, least_known=0.5, low=0.1, high=0.9)
    plain = [(1, 0, 20, 20, 0.5, False), (1, 20, 40, 0, None, True), (1, 40, 60, 20, 0.0, True), (1, 60, 63, 3, 1 / 3, False)]
    for source in (None, "", "=", "none", "a/b"):
        own = track.where(F.col("source").eqNullSafe(F.lit(source)))
        assert sorted(map(tuple, own.select("doc_id", "s", "e", "known", "value", "odd").collect())) == plain
        assert [tuple(r) for r in mask.where(F.col("source").eqNullSafe(F.lit(source))).select("doc_id", "s", "e").collect()] == [(1, 20, 60)]
    own = sorted(map(tuple, track.where("source = 'a'").select("doc_id", "s", "e", "known", "value", "odd").collect()))
    assert own == [(1, 0, 20, 24, 14 / 24, False), *plain[1:], (4, 0, 20, 0, None, True), (4, 20, 25, 0, None, True)]
    assert sorted(map(tuple, mask.where("source = 'a'").select("doc_id", "s", "e").collect())) == [(1, 20, 60), (4, 0, 25)]


def test_a_rerun_replaces(spark, tmp_path):
    first = [_rows(x) for x in _track(spark, [(k, "gattaca " * k, "en", f"s{k % 3}", 0, 0, "") for k in range(40)], tmp_path, width=16)]
    again = [_rows(x) for x in _track(spark, [(k, "gattaca " * k, "en", f"s{k % 3}", 0, 0, "") for k in range(40)], tmp_path, width=16)]
    assert first == again and first[0]
    fewer = _track(spark, [(1, "gattaca", "en", "s1", 0, 0, "")], tmp_path, width=16)
    assert [r[0] for r in fewer[0].select("source").distinct().collect()] == ["s1"]


def test_no_documents_and_a_very_long_one(spark, tmp_path):
    assert [_rows(x) for x in _track(spark, [], tmp_path)] == [[], []]
    track, mask = _track(spark, [(1, "gattacagattaca " * 400_000, "en", "a", 0, 0, "")], tmp_path, "long")
    assert track.count() == 12_000 and track.agg(F.sum("known")).first()[0] == 14 * 400_000
    assert [tuple(r) for r in mask.select("s", "e").collect()] == [(0, 6_000_000)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("supplier", "events", "documents", "lineitem"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = registry.QUERIES[name](spark, str(DATA))
    wanted = connection.sql(registry.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert _rows(found) == sorted((tuple(r[k] for k in order) for r in wanted.fetchall()), key=str)


def test_command_line(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps(load_config("composition_track") | {"width": 5000}))
    root = Path(composition_track.__file__).resolve().parents[1]
    ran = subprocess.run(
        [sys.executable, "-m", "jobs.composition_track", "--tables", str(DATA), "--out", str(tmp_path / "o"), "--config", str(config)],
        cwd=root, capture_output=True, text=True, timeout=300, check=False,
    )
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert list((tmp_path / "o" / "track").glob("source_key=*")) and "rows to" in ran.stderr
