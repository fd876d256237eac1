"""Registered queries against DuckDB on the smallest data, and catalogue hygiene."""

import duckdb
import pytest

import __spark_entry__ as driver
from tallyvane.catalog.registry import load_all
from tallyvane.sources.tables import TABLES
from tools.check import rows_of

DIR = "/root/testdata/sf0.001"
SAMPLE = ["top_movers", "technical_indicators", "forward_returns", "merged_statements", "filing_statements",
          "financial_metrics", "macro_snapshot", "anomaly_scores", "text_sentiment", "detected_events", "linked_news",
          "supported_citations", "vector_search", "hybrid_search", "portfolio_allocations", "equal_weight_equity",
          "opportunity_board", "over_quota"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    q = load_all()[name]
    df = q.run(spark, DIR)
    cur = duck.execute(q.sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(load_all()) <= set(driver.queries())
