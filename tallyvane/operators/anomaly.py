"""Movement anomaly score per company (price change, volume, volatility, deviation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.numeric import clamp
from tallyvane.operators.indicators import ordered_bars
from tallyvane.settings import SETTINGS


def anomaly_scores(bars: DataFrame, weights=SETTINGS.anomaly) -> DataFrame:
    """Component scores from each company's bar window, oldest to newest.

    The "recent" volatility deliberately uses the five oldest returns of the
    window: that is what the scores being matched do.
    """
    rows = ordered_bars(bars)
    move = F.when(F.col("prev_px") > 0, F.abs(F.col("px") - F.col("prev_px")) / F.col("prev_px"))
    at = lambda age, c: F.max(F.when(F.col("age") == age, F.col(c)))
    agg = rows.withColumn("move", move).groupBy("company_id").agg(
        F.max("ts").alias("ts"),
        F.max("n").alias("n_bars"),
        at(1, "px").alias("last_px"),
        at(2, "px").alias("prev_px"),
        at(1, "volume").alias("last_vol"),
        F.sum(F.when(F.col("age").between(2, 21), F.col("volume"))).alias("prior_vol"),
        F.avg(F.when(F.col("rn").between(2, 6), F.col("move"))).alias("recent_move"),
        F.avg(F.when(F.col("rn").between(2, 21), F.col("move"))).alias("base_move"),
        F.avg(F.when(F.col("age") <= 20, F.col("px"))).alias("sma"),
    ).filter("n_bars >= 2")
    change = F.try_divide(F.abs(F.col("last_px") - F.col("prev_px")), F.col("prev_px")) * 100
    ratio = F.try_divide(F.col("last_vol"), F.col("prior_vol") / 20)
    spread = F.try_divide(F.col("recent_move"), F.col("base_move"))
    dev = F.abs(F.try_divide(F.col("last_px") - F.col("sma"), F.col("sma"))) * 100
    enough = F.col("n_bars") >= 21

    def part(c, guard=F.lit(True)):
        return F.coalesce(F.when(guard, clamp(c, 0, 100)), F.lit(0.0))

    scored = agg.select(
        "company_id", "ts", "n_bars",
        part(change * 20).alias("price_change_score"),
        part((ratio - 1) * 25, enough).alias("volume_score"),
        part((spread - 1) * 50, enough).alias("volatility_score"),
        part(dev * 12.5, F.col("n_bars") >= 20).alias("technical_score"),
    )
    total = (F.col("price_change_score") * weights.price_change
             + F.col("volume_score") * weights.volume
             + F.col("volatility_score") * weights.volatility
             + F.col("technical_score") * weights.technical)
    return scored.withColumn("overall_score", total).withColumn(
        "triggered", F.col("overall_score") >= weights.trigger)
