"""Derived tables that are recomputed only for the keys whose source moved.

A stored row carries ``mark``, the newest source time it was computed from. A pass
compares marks of the source with stored marks, computes the changed keys only, and
rewrites only the hash buckets those keys live in, by dynamic partition overwrite. A rerun
finds no newer mark and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.operators import anomaly, events, fundamentals, indicators, risk
from tallyvane.operators.materialize import stored
from tallyvane.sources.writers import append_new, exists, overwrite_day


class KeyedTable:
    """One row per key under ``path``, in ``buckets`` folders by key hash. ``schema`` names the columns besides mark and bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "company_id", buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = f"{schema}, mark timestamp, bucket int"

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def changed(self, marks: DataFrame) -> DataFrame:
        """(key, mark) of keys whose source is newer than their row, or that have none."""
        old = self.read().select(self.key, F.col("mark").alias("_old"))
        met = marks.filter(F.col(self.key).isNotNull()).join(old, self.key, "left")
        return met.filter(F.col("_old").isNull() | (F.col("mark") > F.col("_old"))).drop("_old")

    def replace(self, rows: DataFrame) -> None:
        """Put rows (with mark) in the place of their keys' rows; buckets without such a key aren't touched."""
        fresh = stored(rows.withColumn("bucket", self.bucket()), "refreshed")
        names = self.spark.createDataFrame([], self.schema).columns
        beside = self.read().join(fresh.select("bucket").distinct(), "bucket", "left_semi").join(fresh.select(self.key), self.key, "left_anti")
        # the buckets are read from the folder that is about to be replaced: hold them elsewhere first
        whole = stored(beside.select(*names).unionByName(fresh.select(*names)), "refreshed-buckets")
        overwrite_day(whole.repartition("bucket"), self.path, "bucket")


def refresh(table: KeyedTable, marks: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Recompute the changed keys; ``compute`` gets them (key) and returns their rows. Returns rows written."""
    changed = stored(table.changed(marks), "changed-keys")
    if changed.isEmpty():
        return 0
    rows = stored(compute(changed.select(table.key)).join(changed, table.key), "changed-rows")
    table.replace(rows)
    return rows.count()


TECHNICAL = "company_id bigint, ts timestamp, n_bars bigint, sma_20 double, sma_50 double, rsi_14 double, atr double"
RATIOS = "company_id bigint, period string, gross_margin double, net_margin double, roe double, debt_equity double"
RISK = "company_id bigint, ts timestamp, risk_score double, volatility double, beta double, max_drawdown double"
ANOMALIES = "company_id bigint, ts timestamp, overall_score double, triggered boolean"
ALERTS = ["company_id", "alert_type", "source_id", "day"]


def newest(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Mark of each company: its newest row."""
    return rows.groupBy("company_id").agg(F.max(F.col(ts).cast("timestamp")).alias("mark"))


def of(keys: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(keys, "company_id", "left_semi")


def refresh_technical(table: KeyedTable, bars: DataFrame) -> int:
    return refresh(table, newest(bars), lambda keys: indicators.technical_indicators(of(keys, bars)))


def refresh_ratios(table: KeyedTable, statements: DataFrame) -> int:
    return refresh(table, newest(statements, "period"), lambda keys: fundamentals.financial_metrics(of(keys, statements)))


def refresh_risk(table: KeyedTable, bars: DataFrame, statements: DataFrame, event_rows: DataFrame, since) -> int:
    return refresh(table, newest(bars), lambda keys: risk.risk_metrics(
        of(keys, bars), fundamentals.latest_statement(of(keys, statements)), of(keys, event_rows), since))


def refresh_anomalies(table: KeyedTable, bars: DataFrame, companies: DataFrame, alerts_path: str, weights=None) -> tuple[int, int]:
    """Anomalies of companies with new bars, then one alert per triggered anomaly and day; returns rows and alerts written.

    Alerts go by day, so the check for stored ones reads those days only.
    """
    scores = (lambda b: anomaly.anomaly_scores(b, weights)) if weights else anomaly.anomaly_scores
    written = refresh(table, newest(bars), lambda keys: scores(of(keys, bars)))
    none = table.spark.createDataFrame([], "company_id bigint, alert_type string, source_id bigint")
    rows = table.read().withColumn("anomaly_id", F.unix_timestamp("ts"))
    days = rows.select("company_id", F.col("anomaly_id").alias("source_id"), F.to_date("ts").alias("day"))
    fresh = events.anomaly_alerts(rows, companies, none).join(days, ["company_id", "source_id"]).withColumn("_seq", F.lit(0))
    return written, append_new(fresh, alerts_path, ALERTS, "_seq", ["day"])["inserted"]
