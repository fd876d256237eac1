"""Bar scans, movers, forward returns, reactions and calendars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.operators.asof import asof_join
from tallyvane.operators.latest import latest_with_ties

# fixed values: forward-return horizons in calendar days, and their tolerance
HORIZONS = (("1m", 30), ("3m", 91), ("6m", 182))
TOLERANCE_DAYS = 5


def bar_window(bars: DataFrame, start: dt.datetime, end: dt.datetime,
               companies: DataFrame | None = None) -> DataFrame:
    """Bars in [start, end]; with ``companies`` only theirs (those without bars vanish)."""
    out = bars.filter(F.col("ts").between(F.lit(start), F.lit(end)))
    return out if companies is None else out.join(companies.select("company_id"), "company_id", "left_semi")


def newest_ascending(bars: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` bars of each company, numbered oldest first."""
    w = Window.partitionBy("company_id").orderBy(F.desc("ts"))
    newest = bars.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= limit)
    up = Window.partitionBy("company_id").orderBy("ts")
    return newest.withColumn("pos", F.row_number().over(up)).drop("age")


def top_movers(bars: DataFrame, companies: DataFrame, limit: int = 10) -> DataFrame:
    """Companies whose latest bar moved most between open and close."""
    latest = latest_with_ties(bars, ["company_id"], "ts")
    change = F.coalesce(F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100, F.lit(0.0))
    return (
        latest.join(companies, "company_id")
        .select("ticker", "name", F.col("close").alias("price"),
                change.alias("change_percent"), "volume", (change >= 0).alias("up"))
        .orderBy(F.desc(F.abs("change_percent")), "ticker").limit(limit)
    )


def forward_returns(points: DataFrame, bars: DataFrame, ts: str,
                    horizons=HORIZONS, tolerance_days: int = TOLERANCE_DAYS) -> DataFrame:
    """Returns after each point at every horizon; NULL until the horizon has elapsed.

    Base = first bar at or after the point. Target = last bar at or before
    point + horizon, which must not precede the base nor lie more than the
    tolerance before the target date. The bars travel once, as one array per company
    (bounded by the calendar), however many horizons there are.
    """
    bar = F.struct(F.col("ts").alias("t"), F.col("close").alias("c"))
    series = bars.groupBy("company_id").agg(F.sort_array(F.collect_list(bar)).alias("_bars"))
    target = {label: F.timestamp_seconds(F.unix_timestamp(ts) + days * 86400) for label, days in horizons}

    def last_until(t: Column) -> Column:
        return F.get("_bars", F.size(F.filter("_bars", lambda b: b["t"] <= t)) - 1)

    found = F.struct(F.get("_bars", F.size(F.filter("_bars", lambda b: b["t"] < F.col(ts)))).alias("base"),
                     *[last_until(t).alias(label) for label, t in target.items()])
    # looked up once per point: as the output of a generator the lookups are not repeated by filters on them
    out = points.join(series, "company_id").withColumn("_at", F.explode(F.array(found))).drop("_bars")
    out = out.withColumns({"base_ts": F.col("_at.base.t"), "base_close": F.col("_at.base.c")}).filter(F.col("base_close") > 0)
    for label, t in target.items():
        end = F.col("_at")[label]
        reached = (end["t"] >= F.col("base_ts")) & (F.unix_timestamp(t) - F.unix_timestamp(end["t"]) <= tolerance_days * 86400)
        out = out.withColumn(f"return_{label}", F.when(reached, (end["c"] - F.col("base_close")) / F.col("base_close")))
    return out.drop("_at")


REACTION_BUCKET = 30 * 86400


def with_reaction(events: DataFrame, bars: DataFrame, ts: str, bucket_seconds: int | None = REACTION_BUCKET) -> DataFrame:
    """Every event with the bar before it and the bar a day or more after it (NULL when missing).

    One pass over the events: the price columns ride along, so an expensive
    event plan is never evaluated twice for a self join. A company's events are cut into
    time buckets in both directions, so one that holds a third of all events is spread over tasks.
    """
    px = bars.select("company_id", F.col("ts").alias("bar_ts"), "close", "volume")
    out = asof_join(events, px, ["company_id"], ts, "bar_ts",
                    {"price_before": "close", "volume_before": "volume"}, bucket_seconds=bucket_seconds)
    after = F.timestamp_seconds(F.unix_timestamp(ts) + 86400)
    out = asof_join(out.withColumn("_after", after), px, ["company_id"], "_after", "bar_ts",
                    {"after_ts": "bar_ts", "price_after": "close", "volume_after": "volume"},
                    forward=True, bucket_seconds=bucket_seconds)
    change = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(b))
    return out.drop("_after").withColumns({
        "reacted": F.col("price_before").isNotNull() & F.col("price_after").isNotNull(),
        "price_change": change("price_after", "price_before"),
        "volume_change": change("volume_after", "volume_before"),
        "minutes_to_reaction": F.floor(
            (F.unix_timestamp("after_ts") - F.unix_timestamp(ts)) / 60).cast("long"),
    })


def price_reaction(events: DataFrame, bars: DataFrame, ts: str) -> DataFrame:
    """Events that have both bars."""
    return with_reaction(events, bars, ts).filter("reacted").drop("reacted")


def trading_grid(bars: DataFrame, every: int, keys: list[str] | None = None) -> DataFrame:
    """Every n-th date of the union calendar (position counted from 0).

    Distinct dates are few (calendar-bounded), so ordering them is cheap.
    """
    keys = keys or []
    days = bars.select(*keys, "ts").distinct()
    w = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("ts")
    return (days.withColumn("pos", F.row_number().over(w) - 1)
            .filter(F.col("pos") % every == 0)
            .withColumn("k", (F.col("pos") / every).cast("int")))


def momentum_signal(bars: DataFrame, lookback: int, dates: DataFrame, top_n: int) -> DataFrame:
    """Top-n tickers by positional momentum on each grid date (ties by company)."""
    w = Window.partitionBy("company_id").orderBy("ts")
    past = F.lag("close", lookback).over(w)
    scored = (
        bars.withColumn("momentum", F.when(past > 0, (F.col("close") - past) / past))
        .join(dates.select("ts", "k"), "ts")
        .filter(F.col("momentum").isNotNull())
    )
    by_date = Window.partitionBy("ts").orderBy(F.desc("momentum"), "company_id")
    return scored.withColumn("rank", F.row_number().over(by_date)).filter(F.col("rank") <= top_n)


def trailing_volatility(bars: DataFrame, lookback: int, fallback: float = 0.25) -> DataFrame:
    """Annualised std of up to ``lookback`` trailing returns at each bar."""
    w = Window.partitionBy("company_id").orderBy("ts")
    tail = w.rowsBetween(-(lookback - 1), Window.currentRow)
    rets = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    return rets.withColumn(
        "volatility",
        F.when(F.count("ret").over(tail) >= 2,
               F.stddev_samp("ret").over(tail) * F.sqrt(F.lit(252.0))).otherwise(fallback))


def market_snapshot(bars: DataFrame, depth: int = 30) -> DataFrame:
    """Latest bar, day change and extremes over each company's newest bars."""
    w = Window.partitionBy("company_id").orderBy(F.desc("ts"))
    rows = bars.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= depth)
    at = lambda age, c: F.max(F.when(F.col("age") == age, F.col(c)))
    return rows.groupBy("company_id").agg(
        at(1, "close").alias("latest_price"),
        at(1, "volume").alias("latest_volume"),
        at(1, "ts").alias("latest_date"),
        F.try_divide(at(1, "close") - at(2, "close"), at(2, "close")).alias("price_change_1d"),
        F.max("high").alias("price_high_30d"),
        F.min("low").alias("price_low_30d"),
        F.avg("volume").alias("avg_volume_30d"),
    )


def stalest_first(companies: DataFrame, bars: DataFrame) -> DataFrame:
    """Companies by the age of their newest bar, those without bars first."""
    newest = bars.groupBy("company_id").agg(F.max("ts").alias("newest"))
    return (companies.select("company_id", "ticker").join(newest, "company_id", "left")
            .orderBy(F.asc_nulls_first("newest"), "company_id"))


def normalized_bars(raw: DataFrame, source: str) -> DataFrame:
    """Bars in one form from rows (company_id, timestamp, open, high, low, close, adjusted_close, volume) of text values.

    Times may be epoch seconds, milliseconds or ISO text. A missing number is 0.0, volume is a whole number cut towards zero, and an adjusted close
    that is missing or 0 is null.
    """
    from tallyvane.functions.times import parse_timestamp

    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return raw.select(
        "company_id", parse_timestamp("timestamp").alias("ts"), *[number(c).alias(c) for c in ("open", "high", "low", "close")],
        F.nullif(number("adjusted_close"), F.lit(0.0)).alias("adjusted_close"), number("volume").cast("long").alias("volume"),
        F.lit(source).alias("source"))
