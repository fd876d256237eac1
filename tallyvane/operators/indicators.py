"""Technical indicators for every company in one job.

Rows per company are daily bars, so each group is bounded by the calendar. One
hash exchange on ``company_id`` and one sort serve the windows, and the final
``groupBy`` reuses that partitioning. Exponential averages are weighted sums
(no ordering needed); MACD is one fold over the sorted closes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.numeric import finite

TRADING_DAYS = 252


def price_basis() -> Column:
    """Adjusted close, falling back to close when missing or zero."""
    return F.coalesce(F.nullif(F.col("adjusted_close"), F.lit(0.0)), F.col("close"))


def ordered_bars(bars: DataFrame, close: Column | None = None) -> DataFrame:
    """Bars with previous close, return, running peak, age (1 = newest) and count."""
    by = Window.partitionBy("company_id")
    w = by.orderBy("ts")
    peak = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bars.withColumn("px", close if close is not None else F.col("close"))
        .withColumn("prev_px", F.lag("px").over(w))
        .withColumn("prev_close", F.lag("close").over(w))
        .withColumn("ret", F.try_divide(F.col("px"), F.col("prev_px")) - 1)
        .withColumn("peak", F.max("px").over(peak))
        .withColumn("rn", F.row_number().over(w))
        .withColumn("n", F.count(F.lit(1)).over(by))
        .withColumn("age", F.col("n") - F.col("rn") + 1)
    )


def _last(value: Column, rows: int, fn) -> Column:
    """Aggregate over the newest ``rows`` rows; NULL when the series is shorter."""
    return F.when(F.max("n") >= rows, fn(F.when(F.col("age") <= rows, value)))


def ema_last(value: str, span: int) -> Column:
    """Final recursive exponential average as a weighted sum over ages."""
    a = 2.0 / (span + 1.0)
    decay = F.pow(F.lit(1 - a), F.col("age") - 1)
    weight = F.when(F.col("rn") == 1, decay).otherwise(a * decay)
    return F.when(F.max("n") >= span, F.sum(weight * F.col(value)))


def rsi_last(window: int = 14) -> Column:
    """RSI from exponentially weighted gains and losses; the normaliser cancels."""
    decay = F.pow(F.lit(1 - 1.0 / window), F.col("age") - 1)
    move = F.col("px") - F.col("prev_px")
    gain = F.sum(F.when(move > 0, move * decay).otherwise(0.0))
    loss = F.sum(F.when(move < 0, -move * decay).otherwise(0.0))
    value = (F.when((gain == 0) & (loss == 0), None)
             .when(loss == 0, 100.0)
             .otherwise(100 - 100 / (1 + F.try_divide(gain, loss))))
    return F.when(F.max("n") >= window + 1, value)


def macd_fold(fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(line, signal) folded over the closes in time order."""
    af, as_, ag = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    closes = F.transform(F.array_sort(F.collect_list(F.struct("rn", "px"))), lambda r: r["px"])
    head = F.element_at(closes, 1)
    start = F.struct(head.alias("f"), head.alias("s"), F.lit(0.0).alias("g"))

    def step(acc, x):
        f = acc["f"] + af * (x - acc["f"])
        s = acc["s"] + as_ * (x - acc["s"])
        return F.struct(f.alias("f"), s.alias("s"), (acc["g"] + ag * (f - s - acc["g"])).alias("g"))

    folded = F.aggregate(
        F.slice(closes, 2, F.greatest(F.size(closes) - 1, F.lit(0))), start, step,
        lambda acc: F.struct((acc["f"] - acc["s"]).alias("line"), acc["g"].alias("signal")))
    return F.when(F.max("n") >= slow, folded)


def technical_indicators(bars: DataFrame, min_bars: int = 20) -> DataFrame:
    """One row per company with at least ``min_bars`` bars."""
    rows = ordered_bars(bars, price_basis())
    px = F.col("px")
    true_range = F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - F.lag("px").over(Window.partitionBy("company_id").orderBy("ts"))),
        F.abs(F.col("low") - F.lag("px").over(Window.partitionBy("company_id").orderBy("ts"))))
    rows = rows.withColumn("tr", true_range)
    typical = (F.col("high") + F.col("low") + px) / 3
    at = lambda age: F.max(F.when(F.col("age") == age, px))
    sd20 = _last(px, 20, F.stddev_samp)
    mean20 = _last(px, 20, F.avg)
    out = rows.groupBy("company_id").agg(
        F.max("ts").alias("ts"),
        F.max("n").alias("n_bars"),
        mean20.alias("sma_20"),
        _last(px, 50, F.avg).alias("sma_50"),
        _last(px, 200, F.avg).alias("sma_200"),
        ema_last("px", 20).alias("ema_20"),
        rsi_last(14).alias("rsi_14"),
        macd_fold().alias("_macd"),
        F.when(F.max("n") >= 15, F.avg(F.when(F.col("age") <= 14, F.col("tr")))).alias("atr"),
        (mean20 + 2 * sd20).alias("bollinger_upper"),
        (mean20 - 2 * sd20).alias("bollinger_lower"),
        F.try_divide(F.sum(typical * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.when(F.max("n") >= 31,
               F.stddev_samp(F.when(F.col("age") <= 30, F.col("ret"))) * math.sqrt(TRADING_DAYS))
        .alias("volatility_30d"),
        F.when(F.max("n") >= 11, F.try_divide(at(1) - at(11), at(11)) * 100).alias("momentum"),
        F.abs(F.min(F.try_divide(px - F.col("peak"), F.col("peak")))).alias("drawdown"),
    )
    return (
        out.filter(F.col("n_bars") >= min_bars)
        .withColumn("macd", F.col("_macd.line"))
        .withColumn("macd_signal", F.col("_macd.signal"))
        .drop("_macd")
    )


def rolling_series(bars: DataFrame, n: int = 20) -> DataFrame:
    """Every bar with its trailing SMA, Bollinger band, momentum and volume anomaly."""
    w = Window.partitionBy("company_id").orderBy("ts")
    tail = w.rowsBetween(-(n - 1), Window.currentRow)
    full = F.count(F.lit(1)).over(tail) == n
    mean, sd = F.avg("close").over(tail), F.stddev_samp("close").over(tail)
    avg_vol = F.avg("volume").over(tail)
    seen = F.row_number().over(w)
    past = F.lag("close", 10).over(w)
    return bars.select(
        "company_id", "ts", "close",
        F.when(full, mean).alias("sma"),
        F.when(full, mean + 2 * sd).alias("upper"),
        F.when(full, mean - 2 * sd).alias("lower"),
        (F.try_divide(F.col("close") - past, past) * 100).alias("momentum"),
        F.when(seen >= n + 1, F.try_divide(F.col("volume") - avg_vol, avg_vol) * 100)
        .alias("volume_anomaly"),
    )


def quote_change(bars: DataFrame) -> DataFrame:
    """Newest close per company with its change against the bar before."""
    w = Window.partitionBy("company_id").orderBy(F.desc("ts"))
    # two rows per company survive the group limit; the rest never shuffles
    newest = bars.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return newest.groupBy("company_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("ts"))).alias("ts"),
        F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("price"),
        F.max(F.when(F.col("rn") == 1, F.col("volume"))).alias("volume"),
        F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev_close"),
    ).withColumn("change", F.col("price") - F.col("prev_close")
                 ).withColumn("change_percent",
                              finite(F.try_divide(F.col("change"), F.col("prev_close")) * 100))
