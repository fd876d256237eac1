"""Point-in-time snapshots: nested per ticker, stored one per day, or long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.operators.latest import latest_per_key
from tallyvane.sources.writers import exists, overwrite_day

SNAPSHOT = ("ticker string, as_of timestamp, bars array<struct<ts: timestamp, close: double, volume: bigint>>, "
            "score_ts timestamp, overall_score double, day date")


def snapshot_prices(bars: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """One row per ticker with its ordered bars up to the time (calendar-bounded arrays)."""
    rows = bars.filter(F.col("ts") <= as_of).join(companies.select("company_id", "ticker"), "company_id")
    return rows.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("ts", "close", "volume"))).alias("bars"))


def snapshot_scores(scores: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """Latest score per ticker at the time; 0 is a score."""
    return latest_per_key(scores.filter(F.col("ts") <= as_of), ["company_id"], "ts").join(
        companies.select("company_id", "ticker"), "company_id").select("ticker", "ts", "overall_score")


def read_snapshot(prices: DataFrame, start, end, tickers: list[str] | None = None) -> DataFrame:
    """Snapshot rows back to (ticker, ts, close, volume) within a period."""
    if tickers:
        prices = prices.filter(F.col("ticker").isin([t.upper() for t in tickers]))
    rows = prices.select("ticker", F.explode("bars").alias("b")).select("ticker", "b.*")
    return rows.filter(F.col("ts").between(start, end))


def write_snapshot(bars: DataFrame, scores: DataFrame, companies: DataFrame, as_of, path: str) -> None:
    """Store the snapshot of a time: prices and latest score per ticker, one snapshot per UTC day.

    A second write on the same day replaces that day only (dynamic partition overwrite), so a retried schedule
    leaves one snapshot.
    """
    s = snapshot_scores(scores, companies, as_of).withColumnRenamed("ts", "score_ts")
    rows = snapshot_prices(bars, companies, as_of).join(s, "ticker", "full").select(
        "ticker", as_of.cast("timestamp").alias("as_of"), "bars", "score_ts", "overall_score", as_of.cast("date").alias("day"))
    overwrite_day(rows, path, "day")


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Every stored snapshot row; ``day`` prunes to one snapshot."""
    if not exists(spark, path):
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(path)


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """(day, as_of, tickers, bars, scores) of each stored snapshot."""
    return snapshots.groupBy("day").agg(
        F.max("as_of").alias("as_of"), F.count(F.lit(1)).alias("tickers"), F.sum(F.coalesce(F.size("bars"), F.lit(0))).alias("bars"),
        F.count("overall_score").alias("scores"))


def pinned_prices(snapshots: DataFrame) -> DataFrame:
    """(snapshot_day, ticker, ts, close) of all stored snapshots, for runs that are pinned to one."""
    return snapshots.select(F.col("day").alias("snapshot_day"), "ticker", F.explode("bars").alias("b")).select(
        "snapshot_day", "ticker", "b.ts", "b.close")
