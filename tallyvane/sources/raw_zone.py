"""Append-only landing of vendor payloads as they came, and open reads of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.sources.store import Store

RAW = {"raw": "endpoint string, retrieved_at timestamp, payload string, provider string, day date"}


def raw_zone(spark: SparkSession, root: str) -> Store:
    """Payloads by provider and day of retrieval."""
    return Store(spark, root, RAW, {"raw": ["provider", "day"]})


def land(zone: Store, batch: str, payloads: DataFrame) -> int:
    """Append payload rows (provider, endpoint, retrieved_at, payload) under a batch name.

    Nothing is parsed, so nothing is refused. A batch that is landed already is left alone; returns rows landed.
    """
    return zone.commit(batch, "landing", lambda: {"raw": payloads.withColumn("day", F.to_date("retrieved_at"))}).get("raw", 0)


def open_payloads(zone: Store, provider: str | None = None, day=None) -> DataFrame:
    """Landed rows with ``value``, the payload as VARIANT whatever its shape; null and ``is_bad`` where it is no JSON.

    Provider and day prune folders.
    """
    rows = zone.read("raw")
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider)
    if day is not None:
        rows = rows.filter(F.col("day") == F.lit(day))
    value = F.try_parse_json("payload")
    return rows.withColumn("value", value).withColumn("is_bad", F.col("value").isNull())


def landing_report(zone: Store) -> DataFrame:
    """(provider, day, endpoint, landed, bad, shapes): what landed, how much of it isn't JSON, how many top-level shapes it has."""
    rows = open_payloads(zone)
    return rows.groupBy("provider", "day", "endpoint").agg(
        F.count(F.lit(1)).alias("landed"), F.count_if("is_bad").alias("bad"),
        F.count_distinct(F.schema_of_variant("value")).alias("shapes"))
