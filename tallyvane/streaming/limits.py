"""Request quotas: sliding-window counts in batch, tumbling windows in batch and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def over_quota(requests: DataFrame, key: str, ts: str, limit: int, window_seconds: int, parts: int = 16) -> DataFrame:
    """Requests with their count in the trailing window, quota flag and retry delay.

    A count in [t - window, t] is the difference of two running counts of the key, one up to t and one before
    t - window. Running counts are taken in two levels: sums of buckets of a ``parts``-th of the window, then the
    moments of one bucket. Equal moments are one row with a count, and each moment comes twice, for itself and for the
    begin of its window, so a task holds a short piece of a key's time however busy the key is. A request without
    a time is in no window.
    """
    width = window_seconds * 1_000_000
    step = max(1, width // parts)
    moments = requests.groupBy(key, F.unix_micros(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_c")).filter("_t IS NOT NULL")
    side = F.explode(F.array(F.struct(F.lit(0).alias("own"), (F.col("_t") - width).alias("at")), F.struct(F.lit(1).alias("own"), F.col("_t").alias("at"))))
    rows = moments.withColumn("_s", side).select(
        key, "_t", F.col("_s.own").alias("_own"), F.col("_s.at").alias("_at"), F.when(F.col("_s.own") == 1, F.col("_c")).otherwise(0).alias("_c"),
        F.floor(F.col("_s.at") / step).alias("_b"))
    seen = F.when(F.col("_own") == 1, F.col("_at"))
    grid = rows.groupBy(key, "_b").agg(F.sum("_c").alias("_n"), F.min(seen).alias("_first"))
    by_bucket = Window.partitionBy(key).orderBy("_b")
    grid = grid.select(
        key, "_b", F.coalesce(F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.first("_first", ignorenulls=True).over(by_bucket.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    # the begin of a window comes before the requests of its moment
    inside = Window.partitionBy(key, "_b").orderBy("_at", "_own")
    rows = rows.withColumn("_run", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_later", F.min(seen).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    total = rows.join(grid, [key, "_b"]).withColumn("_run", F.col("_run") + F.col("_before"))
    sign = F.when(F.col("_own") == 1, F.col("_run")).otherwise(-F.col("_run"))
    windows = total.groupBy(key, "_t").agg(
        F.sum(sign).alias("in_window"), F.min(F.when(F.col("_own") == 0, F.coalesce("_later", "_next"))).alias("_oldest"))
    out = requests.withColumn("_t", F.unix_micros(ts)).join(windows, [key, "_t"], "left").withColumn("in_window", F.coalesce("in_window", F.lit(0)))
    wait = F.ceil((width - (F.col("_t") - F.col("_oldest"))) / 1_000_000)
    return out.withColumn("over", F.col("in_window") > limit).withColumn(
        "retry_after", F.when(F.col("over"), F.greatest(F.lit(1), wait))).select(*requests.columns, "in_window", "over", "retry_after")


def fixed_windows(requests: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Attempts per key and tumbling window (batch or stream)."""
    return requests.groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("attempts")).select(key, F.col("w.start").alias("window_start"), "attempts")


def count_batch(path: str, key: str, ts: str, seconds: int):
    """foreachBatch handler: the batch's own window counts, one folder per batch.

    Counts add up, so a stream needs no state and drops no late row; a replayed
    batch overwrites its folder. ``counted`` sums the folders.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        fixed_windows(batch, key, ts, seconds).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def counted(stored: DataFrame, key: str) -> DataFrame:
    """Attempts per key and window over all batches."""
    return stored.groupBy(key, "window_start").agg(F.sum("attempts").alias("attempts"))
