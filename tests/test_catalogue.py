"""Every query with SQL gives what DuckDB gives; every other one gives rows."""

import duckdb
import pytest

from ledgerlight.plans import catalogue, details, more, requests, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


def test_scope_reaches_the_scan(spark):
    plan = catalogue.scan_scoped_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" in plan and "PushedFilters: [" in plan and "o_totalprice" not in plan


def test_dashboard_agrees_with_analytics(spark):
    board, totals = catalogue.dashboard_snapshot(spark, SF).first(), catalogue.documents_totals(spark, SF).first()
    assert all(board[c] == totals[c] for c in ("total", "validated", "failed", "awaiting_review"))
