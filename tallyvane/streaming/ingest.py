"""Idempotent stream ingest and alerting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators import events as ev
from tallyvane.sources.writers import append_new


def append_batch(path: str, keys: list[str], ts: str = "ts"):
    """foreachBatch handler: append rows whose key is not stored yet (safe to replay).

    A row is never too late: the stored keys decide, not a watermark. The target is
    laid out by day of ``ts`` and only the days of the batch are read, so a key's
    copies must carry the same day.
    """

    def handle(batch: DataFrame, _epoch: int) -> None:
        rows = batch.withColumn("_seq", F.monotonically_increasing_id()).withColumn("day", F.to_date(ts))
        append_new(rows, path, [*keys, "day"], "_seq", ["day"])

    return handle


def alert_batch(companies: DataFrame, alerts_path: str):
    """foreachBatch handler: one alert per triggered anomaly, however often it arrives.

    Alerts lie by the day of the anomaly's ``ts``, so a batch reads the stored alerts of its own days only.
    """

    def handle(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], "company_id long, alert_type string, source_id long")
        days = batch.select("company_id", F.col("anomaly_id").alias("source_id"), F.to_date("ts").alias("day")).distinct()
        fresh = ev.anomaly_alerts(batch, companies, empty).join(days, ["company_id", "source_id"]).withColumn("_seq", F.lit(0))
        append_new(fresh, alerts_path, ["company_id", "alert_type", "source_id", "day"], "_seq", ["day"])

    return handle
