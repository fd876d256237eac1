"""Idempotent writes and drained streams."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyvane.sources import writers
from tallyvane.sources.views import Market
from tallyvane.streaming import ingest, limits

DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_second_append_inserts_nothing(spark, folder):
    rows = Market.open(spark, DIR).bars().withColumn("interval", F.lit("1d")).withColumn("seq", F.lit(0))
    keys = ["company_id", "interval", "ts"]
    first = writers.append_new(rows, folder + "/bars", keys, "seq")
    second = writers.append_new(rows, folder + "/bars", keys, "seq")
    assert first["inserted"] == first["seen"] > 0 and second["inserted"] == 0
    assert spark.read.parquet(folder + "/bars").count() == first["inserted"]


def test_raw_landing_and_daily_overwrite(spark, folder):
    raw = spark.createDataFrame([('{"a":1}',)], "payload string")
    for _ in range(2):
        writers.land_raw(raw, folder + "/raw", "fred", "/x", dt.datetime(2020, 1, 2))
    assert spark.read.parquet(folder + "/raw").count() == 2
    day = lambda d, v: spark.createDataFrame([(v, d)], "v int, snapshot_date string")
    for d, v in (("2020-01-01", 1), ("2020-01-02", 2), ("2020-01-02", 3)):
        writers.overwrite_day(day(d, v), folder + "/snap", "snapshot_date")
    assert sorted(r["v"] for r in spark.read.parquet(folder + "/snap").collect()) == [1, 3]


def test_late_rows_survive_and_replays_add_nothing(spark, folder):
    day = dt.datetime(2020, 1, 20)
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp")
    handle = ingest.append_batch(folder + "/log", ["event_id"])
    handle(frame([(1, day), (2, day), (1, day)]), 0)
    late = frame([(3, day - dt.timedelta(days=10)), (2, day)])
    handle(late, 1)
    handle(late, 1)
    assert sorted(r["event_id"] for r in spark.read.parquet(folder + "/log").collect()) == [1, 2, 3]


def test_windows_counted_by_batch(spark, folder):
    at = lambda minute: dt.datetime(2020, 1, 1, 5, minute)
    frame = lambda minutes: spark.createDataFrame([(7, at(i)) for i in minutes], "user_id long, ts timestamp")
    handle = limits.count_batch(folder + "/counts", "user_id", "ts", 3600)
    for epoch, minutes in ((0, [1, 2]), (1, [3]), (1, [3])):
        handle(frame(minutes), epoch)
    assert [r["attempts"] for r in limits.counted(spark.read.parquet(folder + "/counts"), "user_id").collect()] == [3]


def test_alert_batches_alert_once(spark, folder):
    companies = spark.createDataFrame([(1, "S1")], "company_id long, ticker string")
    batch = spark.createDataFrame([(1, 7, 91.0, True, dt.datetime(2020, 1, 1))],
                                  "company_id long, anomaly_id long, overall_score double, triggered boolean, ts timestamp")
    handle = ingest.alert_batch(companies, folder + "/alerts")
    handle(batch, 0)
    handle(batch, 1)
    rows = spark.read.parquet(folder + "/alerts").collect()
    assert [(r["severity"], r["message"]) for r in rows] == [("high", "S1 price anomaly detected (score 91)")]


def test_quota_of_a_hot_key_against_brute_force(spark):
    import datetime as dt
    import random

    from tallyvane.streaming import limits

    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if rng.random() < 0.4 else rng.randrange(2, 6), start + dt.timedelta(seconds=rng.randrange(3000), microseconds=rng.choice([0, 0, 5]))) for i in range(700)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(5)] + [(2000, 9, start)]
    got = {r["i"]: (r["in_window"], r["over"], r["retry_after"]) for r in limits.over_quota(
        spark.createDataFrame(rows, "i int, k int, at timestamp"), "k", "at", 4, 60, parts=7).collect()}
    for i, k, at in rows:
        inside = [t for _, j, t in rows if j == k and at - dt.timedelta(seconds=60) <= t <= at]
        n = len(inside)
        left = 60 - (at - min(inside)).total_seconds()
        assert got[i] == (n, n > 4, max(1, -int(-left // 1)) if n > 4 else None)
