"""Macro snapshot, regime and trends from a long (indicator, ts, value) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.asof import nearest_in_time

SIGNALS = ("fed_funds_rate", "treasury_3m", "treasury_2y", "treasury_10y", "treasury_30y", "gdp",
           "unemployment_rate", "vix")


def latest_values(macro: DataFrame) -> DataFrame:
    """Newest value and time per indicator."""
    return macro.groupBy("indicator").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def inflation(macro: DataFrame, as_of, indicator: str = "cpi", days: int = 500) -> DataFrame:
    """One row: year-on-year percent change of an index level, or the level itself."""
    since = F.timestamp_seconds(F.unix_timestamp(as_of) - days * 86400)
    own = macro.filter(F.col("indicator") == indicator)
    window = own.filter(F.col("ts") >= since)
    counts = window.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
    pair = nearest_in_time(window, ["indicator"], "ts", "value", 365).join(counts, "indicator")
    latest = latest_values(own).select("indicator", "value")
    yoy = F.when((F.col("n") >= 2) & (F.col("latest_value") != 0) & (F.col("prior_value") != 0),
                 F.bround((F.col("latest_value") - F.col("prior_value")) / F.col("prior_value") * 100, 1))
    return latest.join(pair, "indicator", "left").select(
        F.coalesce(yoy, F.when(F.col("n") >= 2, F.col("latest_value")), F.col("value")).alias("cpi"))


def regime(row: dict[str, Column]) -> Column:
    """First matching rule: high_volatility, contraction_risk, expansion, neutral; else unknown."""
    any_signal = F.coalesce(*[row[k].cast("string") for k in (
        "fed_funds_rate", "yield_curve_inverted", "unemployment_rate", "vix", "cpi", "gdp")]).isNotNull()
    return (F.when(row["vix"] > 30, "high_volatility")
            .when(row["yield_curve_inverted"] | (row["fed_funds_rate"] > 5), "contraction_risk")
            .when(row["unemployment_rate"] < 4, "expansion")
            .when(any_signal, "neutral").otherwise("unknown"))


def trend_of(regime_col) -> Column:
    r = F.col(regime_col)
    return (F.when(r == "expansion", "bullish")
            .when(r.isin("contraction_risk", "high_volatility"), "bearish")
            .when(r == "unknown", "unknown").otherwise("neutral"))


def macro_snapshot(macro: DataFrame, as_of) -> DataFrame:
    """One row with every signal, curve slope, regime and trend (NULL = unknown)."""
    latest = latest_values(macro)
    pick = lambda i, c: F.max(F.when(F.col("indicator") == i, F.col(c)))
    row = latest.agg(*[pick(s, "value").alias(s) for s in SIGNALS],
                     pick("fed_funds_rate", "ts").alias("fed_funds_rate_date"))
    cpi = inflation(macro, as_of)
    row = row.withColumn("cpi", cpi.scalar())
    both = (F.col("treasury_10y") != 0) & (F.col("treasury_2y") != 0)
    row = row.withColumn("yield_curve_slope", F.when(both, F.col("treasury_10y") - F.col("treasury_2y")))
    row = row.withColumn("yield_curve_inverted", F.col("yield_curve_slope") < 0)
    row = row.withColumn("economic_regime", regime({c: F.col(c) for c in row.columns}))
    return row.withColumn("economic_trend", trend_of("economic_regime"))


def series_trends(macro: DataFrame, since) -> DataFrame:
    """First against last value of each indicator since a time."""
    g = macro.filter((F.col("ts") >= since) & F.col("value").isNotNull()).groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", "ts").alias("earliest"),
        F.max_by("value", "ts").alias("latest"))
    change = F.when(F.col("n") >= 2, F.col("latest") - F.col("earliest"))
    return g.withColumn("change", change).select(
        "indicator",
        F.when(F.col("n") < 2, "unknown").when(F.col("change") > 0, "rising")
        .when(F.col("change") < 0, "falling").otherwise("stable").alias("trend"),
        "change",
        (F.try_divide(F.col("change"), F.col("earliest")) * 100).alias("percent_change"),
        F.when(F.col("n") >= 2, F.col("latest")).alias("latest"),
        F.when(F.col("n") >= 2, F.col("earliest")).alias("earliest"))


def market_overview(snapshot: DataFrame) -> DataFrame:
    """Trend, volatility and risk labels of a snapshot row; missing VIX is unknown, not low."""
    vix = F.col("vix")
    volatility = (F.when(vix.isNull(), "unknown").when(vix > 30, "high")
                  .when(vix > 20, "moderate").otherwise("low"))
    return snapshot.withColumn("volatility", volatility).withColumn(
        "risk_level",
        F.when(F.col("economic_regime").isin("contraction_risk", "high_volatility"), "high")
        .when((F.col("economic_regime") == "unknown") | (F.col("volatility") == "unknown"), "unknown")
        .when(F.col("volatility") == "moderate", "medium").otherwise("low"),
    ).withColumn("trend", trend_of("economic_regime"))


def indicator_series(macro: DataFrame, indicator: str, since) -> DataFrame:
    """(ts, value) of one indicator since a time, oldest first."""
    return macro.filter((F.col("indicator") == indicator) & (F.col("ts") >= since)).select("ts", "value").orderBy("ts")
