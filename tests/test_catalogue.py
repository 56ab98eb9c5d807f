"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables."""

import os
from pathlib import Path

import pytest

from repliphase.plans import catalogue

FOLDER = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(rows):
    return sorted((tuple(float(x) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    wanted = duck.sql(catalogue.ORACLES[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    rows = plain(found.select(*columns).collect())
    assert rows == plain(tuple(r[k] for k in order) for r in wanted.fetchall())
    assert rows or name in ("pending_except",)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"landmark_seriation", "landmark_extension"}
