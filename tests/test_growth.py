"""Plans that must not read, shuffle or hold more than once what grows with the tables."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from tallyvane.catalog.registry import load_all
from tallyvane.operators import embedding, portfolio
from tallyvane.sources import vendor


def exchanges(df) -> int:
    """Hash shuffles of the plan before it runs."""
    return len(re.findall("Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_portfolio_rows_travel_once(spark):
    rows = [(p, f"t{i}", i, 50.0 + i, 20.0, None if i == 7 else "AB"[i % 2], 0.2) for p in (1, 2) for i in range(8)] + [(1, "T0", 99, 1.0, 1.0, "B", 0.9)]
    df = spark.createDataFrame(rows, "portfolio_id long, ticker string, seq int, score double, risk_score double, sector string, volatility double")
    df = df.withColumns({"risk_profile": F.lit("moderate"), "max_position_weight": F.lit(0.12), "max_sector_weight": F.lit(0.3),
                         "capital": F.lit(1000.0), "cash_reserve": F.lit(100.0)})
    w = portfolio.target_weights(df, ["portfolio_id"])
    book = portfolio.portfolio_summary(w, ["portfolio_id"])
    assert exchanges(w) == 1 and exchanges(book) == 1
    # a position without a sector is a position
    assert {r["portfolio_id"]: r["n"] for r in book.collect()} == {1: 8, 2: 8}
    assert {(r["portfolio_id"], r["seq"]) for r in w.filter("ticker = 'T0'").collect()} == {(1, 0), (2, 0)}


def test_filings_are_parsed_once(spark):
    def point(start, end, val, filed, form="10-Q"):
        return {"start": start, "end": end, "val": val, "form": form, "filed": filed, "accn": filed, "fp": "Q1", "fy": 2020}

    usd = lambda *points: {"units": {"USD": list(points)}}
    gaap = {"Revenues": usd(point("2020-01-01", "2020-03-31", 5.0, "2020-04-30"), point("2020-01-01", "2020-03-31", 6.0, "2020-05-30")),
            "Assets": usd(point(None, "2020-03-31", 9.0, "2020-04-30")),
            "LongTermDebt": usd(point(None, "2020-03-31", 3.0, "2020-04-30")),
            "DebtLongtermAndShorttermCombined": usd(point(None, "2020-03-31", 1.0, "2020-04-30"))}
    payloads = spark.createDataFrame([(1, json.dumps({"facts": {"us-gaap": gaap}}))], "company_id long, payload string")
    out = vendor.filing_statements(payloads)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate explode") == 3
    (row,) = out.collect()
    assert (row["period"], row["period_type"], row["revenue"], row["total_assets"]) == ("2020-03-31", "quarterly", 6.0, 9.0)


def query_plan(spark, name):
    out = load_all()[name].run(spark, "/root/testdata/sf0.001")
    return out, out._jdf.queryExecution().optimizedPlan().toString()


def test_quality_looks_up_no_price(spark):
    _, plan = query_plan(spark, "data_quality")
    trades = [line for line in plan.splitlines() if "l_shipdate" in line and "Relation" not in line]
    # days of trades are counted, no price of theirs is in the plan
    assert trades and not any("l_tax" in line for line in trades)


def test_sections_share_bars_and_statements(spark):
    out, plan = query_plan(spark, "research_sections")
    # trades are scanned for companies with few recent bars only
    assert sum("Relation" in line and "l_shipdate" in line for line in plan.splitlines()) == 1
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()


def test_newest_bars_of_short_and_long_companies(spark):
    load_all()
    from tallyvane.catalog.sections import newest_bars

    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    rows = spark.createDataFrame([(1, day(i)) for i in range(5)] + [(2, day(0)), (2, day(4))], "company_id long, ts timestamp")

    class Two:
        def bars(self):
            return rows

        def recent_bars(self, days):
            return rows.filter(F.col("ts") >= day(3))

    got = sorted((r["company_id"], r["ts"].day) for r in newest_bars(Two(), 2).collect())
    assert got == [(1, 4), (1, 5), (2, 1), (2, 5)]


def test_embedding_holds_one_chunk(spark):
    items = spark.range(0, 2500, 1, 1).select("id", F.when(F.col("id") != 7, F.concat(F.lit("w"), "id")).alias("text"))

    def encoder(texts):
        import sys

        # a batch taken apart whole would be a frame in a caller's locals
        frame, whole = sys._getframe(), 0
        while frame:
            whole = max([whole, *[len(v) for v in frame.f_locals.values() if type(v).__name__ in ("DataFrame", "list")]])
            frame = frame.f_back
        return [[float(whole), 1.0] for _ in texts]

    got = embedding.embed(items, "text", encoder, chunk=50).collect()
    assert len(got) == 2500 and max(r["embedding"][0] for r in got) <= 100
