"""Queries over macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import day_text, rnd, sql_day
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import macro as mac

add_view("macro_latest", "macro", """
    SELECT indicator, arg_max(value, ts) AS value, max(ts) AS ts FROM macro GROUP BY 1""")
add_view("macro_row", "macro_latest macro facts", """
    SELECT *, t10 - t2 AS slope FROM (
      SELECT max(value) FILTER (indicator = 'fed_funds_rate') AS fed, max(ts) FILTER (indicator = 'fed_funds_rate') AS fed_ts,
             max(value) FILTER (indicator = 'treasury_10y') AS t10, max(value) FILTER (indicator = 'treasury_2y') AS t2,
             max(value) FILTER (indicator = 'gdp') AS gdp, max(value) FILTER (indicator = 'unemployment_rate') AS unemp,
             max(value) FILTER (indicator = 'vix') AS vix,
             (SELECT round_even((l.value - p.value) / p.value * 100, 1) FROM macro_latest l,
                LATERAL (SELECT value FROM macro, facts WHERE indicator = 'cpi' AND macro.ts >= as_of - INTERVAL 500 DAY
                         ORDER BY abs(date_diff('second', macro.ts, l.ts - INTERVAL 365 DAY)), macro.ts LIMIT 1) p
              WHERE l.indicator = 'cpi') AS cpi
      FROM macro_latest)""")
add_view("regimes", "macro_row", """
    SELECT *, CASE WHEN vix > 30 THEN 'high_volatility' WHEN slope < 0 OR fed > 5 THEN 'contraction_risk'
                   WHEN unemp < 4 THEN 'expansion'
                   WHEN coalesce(fed, slope, unemp, vix, cpi, gdp) IS NOT NULL THEN 'neutral' ELSE 'unknown' END AS regime
    FROM macro_row""")


@query("macro_snapshot", "G21 E10 J19", with_views("regimes", f"""
    SELECT fed AS fed_funds_rate, {sql_day("fed_ts", "fed_funds_rate_date")}, t10 AS treasury_10y, t2 AS treasury_2y,
           round(slope, 6) AS yield_curve_slope, slope < 0 AS yield_curve_inverted, cpi, gdp,
           unemp AS unemployment_rate, vix, regime AS economic_regime,
           CASE WHEN regime = 'expansion' THEN 'bullish' WHEN regime IN ('contraction_risk', 'high_volatility') THEN 'bearish'
                WHEN regime = 'unknown' THEN 'unknown' ELSE 'neutral' END AS economic_trend
    FROM regimes"""))
def macro_snapshot(m):
    s = mac.macro_snapshot(m.macro(), m.now)
    return s.select("fed_funds_rate", day_text("fed_funds_rate_date"), "treasury_10y", "treasury_2y",
                    *rnd("yield_curve_slope"), "yield_curve_inverted", "cpi", "gdp", "unemployment_rate", "vix",
                    "economic_regime", "economic_trend")


@query("monthly_regimes", "J19", with_views("macro", f"""
    SELECT {sql_day("ts")}, CASE WHEN vix > 30 THEN 'high_volatility'
             WHEN coalesce(t10 - t2 < 0, false) OR coalesce(fed > 5, false) THEN 'contraction_risk'
             WHEN unemp < 4 THEN 'expansion'
             WHEN coalesce(fed, t10 - t2, unemp, vix, gdp) IS NOT NULL THEN 'neutral' ELSE 'unknown' END AS regime
    FROM (SELECT ts, max(value) FILTER (indicator = 'fed_funds_rate') AS fed, max(value) FILTER (indicator = 'treasury_10y') AS t10,
                 max(value) FILTER (indicator = 'treasury_2y') AS t2, max(value) FILTER (indicator = 'unemployment_rate') AS unemp,
                 max(value) FILTER (indicator = 'vix') AS vix, max(value) FILTER (indicator = 'gdp') AS gdp
          FROM macro GROUP BY ts)"""))
def monthly_regimes(m):
    """The regime rules applied to every month of the series."""
    pick = lambda i: F.max(F.when(F.col("indicator") == i, F.col("value"))).alias(i)
    wide = m.macro().groupBy("ts").agg(*[pick(i) for i in mac.SIGNALS]).withColumn("cpi", F.lit(None).cast("double"))
    wide = wide.withColumn("yield_curve_inverted", F.col("treasury_10y") - F.col("treasury_2y") < 0)
    return wide.select(day_text("ts"), mac.regime({c: F.col(c) for c in wide.columns}).alias("regime"))


@query("macro_trends", "G20", with_views("macro facts", """
    SELECT indicator, CASE WHEN n < 2 THEN 'unknown' WHEN l > e THEN 'rising' WHEN l < e THEN 'falling' ELSE 'stable' END AS trend,
           CASE WHEN n >= 2 THEN round(l - e, 6) END AS change, CASE WHEN n >= 2 THEN round((l - e) / nullif(e, 0) * 100, 6) END AS percent_change,
           CASE WHEN n >= 2 THEN l END AS latest, CASE WHEN n >= 2 THEN e END AS earliest
    FROM (SELECT indicator, count(*) AS n, arg_min(value, ts) AS e, arg_max(value, ts) AS l
          FROM macro, facts WHERE ts >= as_of - INTERVAL 365 DAY GROUP BY 1)"""))
def macro_trends(m):
    out = mac.series_trends(m.macro(), m.days_ago(365))
    return out.select("indicator", "trend", *rnd("change", "percent_change"), "latest", "earliest")


@query("market_overview", "H14 G21", with_views("regimes", """
    SELECT CASE WHEN regime = 'expansion' THEN 'bullish' WHEN regime IN ('contraction_risk', 'high_volatility') THEN 'bearish'
                WHEN regime = 'unknown' THEN 'unknown' ELSE 'neutral' END AS trend,
           volatility, CASE WHEN regime IN ('contraction_risk', 'high_volatility') THEN 'high'
                            WHEN regime = 'unknown' OR volatility = 'unknown' THEN 'unknown'
                            WHEN volatility = 'moderate' THEN 'medium' ELSE 'low' END AS risk_level, regime AS economic_regime
    FROM (SELECT *, CASE WHEN vix IS NULL THEN 'unknown' WHEN vix > 30 THEN 'high' WHEN vix > 20 THEN 'moderate' ELSE 'low' END AS volatility
          FROM regimes)"""))
def market_overview(m):
    return mac.market_overview(mac.macro_snapshot(m.macro(), m.now)).select(
        "trend", "volatility", "risk_level", "economic_regime")
