"""Event-to-reaction matching of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reactions(causes: DataFrame, effects: DataFrame, key: str, within_seconds: int, delay: str = "1 day") -> DataFrame:
    """Effects of the same key at or after a cause and within the given time.

    Both sides carry a watermark, so state older than the interval is dropped.
    """
    c = causes.withWatermark("ts", delay).select(
        F.col(key).alias("_k"), F.col("event_id").alias("cause_id"), F.col("ts").alias("cause_ts"))
    e = effects.withWatermark("ts", delay).select(
        key, F.col("event_id").alias("effect_id"), F.col("ts").alias("effect_ts"))
    on = (F.col("_k") == F.col(key)) & (F.col("effect_ts") >= F.col("cause_ts")) & (
        F.col("effect_ts") <= F.col("cause_ts") + F.expr(f"INTERVAL {within_seconds} SECONDS"))
    return c.join(e, on).select(key, "cause_id", "effect_id", "cause_ts", "effect_ts")
