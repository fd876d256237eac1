"""Trades and bars travel once, whatever number of stages reads them."""

import datetime as dt

from pyspark.sql import functions as F

from tallyvane.catalog.registry import load_all
from tallyvane.operators.pricing import forward_returns
from tallyvane.sources.views import Market


def test_stored_runs_aggregate_trades_twice(spark, monkeypatch):
    """Once for bars, once for statements."""
    load_all()
    from tallyvane.catalog import runs

    m = Market.open(spark, "/root/testdata/sf0.001")
    assert m.as_of and m.n_companies
    read, real = [], Market.table
    monkeypatch.setattr(Market, "table", lambda self, name: read.append(name) or real(self, name))
    store = runs.stored_runs(m)
    assert read.count("lineitem") == 2
    assert store.read("runs").count() == 14


def test_forward_returns_read_bars_once(spark):
    start = dt.datetime(2020, 1, 1)
    bars = spark.range(300).select(F.lit(1).alias("company_id"), F.timestamp_seconds(F.lit(int(start.timestamp())) + F.col("id") * 86400).alias("ts"),
                                   (100.0 + F.col("id")).alias("close"))
    points = spark.createDataFrame([(1, start + dt.timedelta(days=3)), (1, start + dt.timedelta(days=400)), (2, start)], "company_id int, at timestamp")
    out = forward_returns(points, bars, "at")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 300") == 1
    (row,) = out.filter("return_3m > 0").collect()
    assert (row["base_close"], row["return_1m"], row["return_6m"]) == (103.0, 30 / 103, 182 / 103)
