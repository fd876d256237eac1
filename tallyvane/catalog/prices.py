"""Queries over daily bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyvane.catalog.common import day_text, rnd, sql_day, sql_rnd, time_text, sql_time
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import anomaly, asof, indicators, pricing
from tallyvane.operators.latest import latest_per_key

add_view("bar_rows", "bars", """
    SELECT *, lag(close) OVER w AS prev, row_number() OVER w AS rn,
           row_number() OVER (PARTITION BY company_id ORDER BY ts DESC) AS age,
           count(*) OVER (PARTITION BY company_id) AS n
    FROM bars WINDOW w AS (PARTITION BY company_id ORDER BY ts)""")


@query("top_movers", "E4 H1", with_views("bars companies", """
    SELECT ticker, name, close AS price, round((close - open) / open * 100, 6) AS change_percent,
           volume, close >= open AS up
    FROM (SELECT *, rank() OVER (PARTITION BY company_id ORDER BY ts DESC) AS r FROM bars) b
    JOIN companies USING (company_id) WHERE r = 1
    ORDER BY abs((close - open) / open) DESC, ticker LIMIT 10"""))
def top_movers(m):
    out = pricing.top_movers(m.bars(), m.companies())
    return out.select("ticker", "name", "price", *rnd("change_percent"), "volume", "up")


@query("bar_window_scan", "A1 A4", with_views("bars facts", f"""
    SELECT company_id, {sql_day("ts")}, close, volume FROM bars, facts
    WHERE ts BETWEEN as_of - INTERVAL 252 DAY AND as_of"""))
def bar_window_scan(m):
    return m.recent_bars(252).select("company_id", day_text("ts"), "close", "volume")


@query("adjusted_close_scan", "A2", with_views("bars facts", f"""
    SELECT company_id, {sql_day("ts")}, coalesce(nullif(adjusted_close, 0), close) AS px
    FROM bars, facts WHERE ts >= as_of - INTERVAL 365 DAY"""))
def adjusted_close_scan(m):
    return m.recent_bars(365).select("company_id", day_text("ts"), indicators.price_basis().alias("px"))


@query("period_scan_for_sector", "A5", with_views("bars companies", f"""
    SELECT company_id, {sql_day("ts")}, close, volume FROM bars
    WHERE ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'
      AND company_id IN (SELECT company_id FROM companies WHERE sector = 'EUROPE')"""))
def period_scan_for_sector(m):
    start, end = dt.datetime(1998, 1, 1), dt.datetime(1999, 12, 31)
    wanted = m.companies().filter(F.col("sector") == "EUROPE")
    return (pricing.bar_window(m.bars(since=start, until=end), start, end, wanted)
            .select("company_id", day_text("ts"), "close", "volume"))


@query("newest_bars_ascending", "A9", with_views("bar_rows", f"""
    SELECT company_id, {sql_day("ts")}, close,
           row_number() OVER (PARTITION BY company_id ORDER BY ts) AS pos
    FROM bar_rows WHERE age <= 25"""))
def newest_bars_ascending(m):
    return pricing.newest_ascending(m.bars(), 25).select("company_id", day_text("ts"), "close", "pos")


@query("bars_by_staleness", "F2", with_views("bars companies", f"""
    SELECT company_id, ticker, {sql_day("newest")}
    FROM companies LEFT JOIN (SELECT company_id, max(ts) AS newest FROM bars GROUP BY 1)
    USING (company_id)"""))
def bars_by_staleness(m):
    """Every company with its newest bar, stalest first."""
    return pricing.stalest_first(m.companies(), m.bars()).select("company_id", "ticker", day_text("newest"))


@query("simple_returns", "G1 H12", with_views("bar_rows", f"""
    SELECT company_id, {sql_day("ts")}, round(close / prev - 1, 9) AS ret
    FROM bar_rows WHERE prev IS NOT NULL"""))
def simple_returns(m):
    rows = indicators.ordered_bars(m.bars()).filter("ret IS NOT NULL")
    return rows.select("company_id", day_text("ts"), *rnd("ret", digits=9))


_TECH = ["sma_20", "sma_50", "sma_200", "ema_20", "rsi_14", "macd", "macd_signal", "atr",
         "bollinger_upper", "bollinger_lower", "vwap", "volatility_30d", "momentum", "drawdown"]


def tech_sql(days: int) -> tuple[str, str]:
    """CTE names and text: independent restatement with list folds and plain aggregates."""
    add_view("tech_rows", "bars facts", f"""
        SELECT *, coalesce(nullif(adjusted_close, 0), close) AS px,
               lag(coalesce(nullif(adjusted_close, 0), close)) OVER w AS prev,
               max(coalesce(nullif(adjusted_close, 0), close)) OVER
                   (PARTITION BY company_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak,
               row_number() OVER w AS rn, count(*) OVER (PARTITION BY company_id) AS n
        FROM bars, facts WHERE ts >= as_of - INTERVAL {days} DAY
        WINDOW w AS (PARTITION BY company_id ORDER BY ts)""")
    add_view("macd_lists", "tech_rows", """
        SELECT company_id,
               list_reduce(list({'f': px, 's': px, 'g': 0.0::DOUBLE, 'n': n} ORDER BY ts),
                 lambda a, x: {'f': a.f + 2.0 / 13 * (x.f - a.f),
                               's': a.s + 2.0 / 27 * (x.s - a.s),
                               'g': a.g + 2.0 / 10 * (a.f + 2.0 / 13 * (x.f - a.f)
                                    - (a.s + 2.0 / 27 * (x.s - a.s)) - a.g),
                               'n': x.n}) AS r
        FROM tech_rows GROUP BY company_id""")
    add_view("technical", "tech_rows macd_lists", """
        SELECT company_id, max(ts) AS ts, max(n) AS n_bars,
          CASE WHEN max(n) >= 20 THEN avg(px) FILTER (n - rn < 20) END AS sma_20,
          CASE WHEN max(n) >= 50 THEN avg(px) FILTER (n - rn < 50) END AS sma_50,
          CASE WHEN max(n) >= 200 THEN avg(px) FILTER (n - rn < 200) END AS sma_200,
          CASE WHEN max(n) >= 20 THEN sum(px * CASE WHEN rn = 1 THEN 1 ELSE 2.0 / 21 END
                                          * pow(19.0 / 21, n - rn)) END AS ema_20,
          CASE WHEN max(n) >= 15 THEN
            CASE WHEN sum(CASE WHEN px < prev THEN 1 ELSE 0 END) = 0
                 THEN CASE WHEN sum(CASE WHEN px > prev THEN 1 ELSE 0 END) = 0 THEN NULL ELSE 100 END
                 ELSE 100 - 100 / (1 + coalesce(sum((px - prev) * pow(13.0 / 14, n - rn)) FILTER (px > prev), 0)
                                      / sum((prev - px) * pow(13.0 / 14, n - rn)) FILTER (px < prev)) END
          END AS rsi_14,
          CASE WHEN max(n) >= 26 THEN any_value(r.f - r.s) END AS macd,
          CASE WHEN max(n) >= 26 THEN any_value(r.g) END AS macd_signal,
          CASE WHEN max(n) >= 15 THEN avg(greatest(high - low, abs(high - prev), abs(low - prev)))
                                      FILTER (n - rn < 14) END AS atr,
          CASE WHEN max(n) >= 20 THEN avg(px) FILTER (n - rn < 20) + 2 * stddev_samp(px) FILTER (n - rn < 20) END AS bollinger_upper,
          CASE WHEN max(n) >= 20 THEN avg(px) FILTER (n - rn < 20) - 2 * stddev_samp(px) FILTER (n - rn < 20) END AS bollinger_lower,
          sum((high + low + px) / 3 * volume) / nullif(sum(volume), 0) AS vwap,
          CASE WHEN max(n) >= 31 THEN stddev_samp(px / prev - 1) FILTER (n - rn < 30) * sqrt(252) END AS volatility_30d,
          CASE WHEN max(n) >= 11 THEN (max(px) FILTER (rn = n) - max(px) FILTER (n - rn = 10))
                                      / max(px) FILTER (n - rn = 10) * 100 END AS momentum,
          abs(min((px - peak) / peak)) AS drawdown
        FROM tech_rows JOIN macd_lists USING (company_id)
        GROUP BY company_id HAVING max(n_bars_guard) >= 20""".replace("max(n_bars_guard)", "max(n)"))
    return "technical", ""


TECH_DAYS = 1095
tech_sql(TECH_DAYS)


@query("technical_indicators", "G2 G3 G4 G5 G6 G7 G8 G9 G10 G12 F5 N1", with_views("technical", f"""
    SELECT company_id, {sql_day("ts")}, n_bars, {sql_rnd(*_TECH, digits=7)} FROM technical"""))
def technical_indicators(m):
    out = indicators.technical_indicators(m.recent_bars(TECH_DAYS))
    return out.select("company_id", day_text("ts"), "n_bars", *rnd(*_TECH, digits=7))


@query("rolling_bands", "G2 G7 G9 G11", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, close,
           CASE WHEN count(*) OVER t = 20 THEN round(avg(close) OVER t, 6) END AS sma,
           CASE WHEN count(*) OVER t = 20 THEN round(avg(close) OVER t + 2 * stddev_samp(close) OVER t, 6) END AS upper,
           CASE WHEN count(*) OVER t = 20 THEN round(avg(close) OVER t - 2 * stddev_samp(close) OVER t, 6) END AS lower,
           round((close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100, 6) AS momentum,
           CASE WHEN row_number() OVER w >= 21
                THEN round((volume - avg(volume) OVER t) / avg(volume) OVER t * 100, 6) END AS volume_anomaly
    FROM bars WINDOW w AS (PARTITION BY company_id ORDER BY ts),
                     t AS (PARTITION BY company_id ORDER BY ts ROWS 19 PRECEDING)"""))
def rolling_bands(m):
    return indicators.rolling_series(m.bars()).select(
        "company_id", day_text("ts"), "close", *rnd("sma", "upper", "lower", "momentum", "volume_anomaly"))


@query("quote_change", "G22", with_views("bar_rows", f"""
    SELECT company_id, {sql_day("ts")}, close AS price, volume, prev AS prev_close,
           round(close - prev, 6) AS change, round((close - prev) / prev * 100, 6) AS change_percent
    FROM bar_rows WHERE age = 1"""))
def quote_change(m):
    return indicators.quote_change(m.bars()).select(
        "company_id", day_text("ts"), "price", "volume", "prev_close", *rnd("change", "change_percent"))


ANOMALY_DAYS = 400
add_view("anomaly_rows", "bars facts", f"""
    SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY ts) AS prev,
           row_number() OVER (PARTITION BY company_id ORDER BY ts) AS rn,
           count(*) OVER (PARTITION BY company_id) AS n
    FROM bars, facts WHERE ts >= as_of - INTERVAL {ANOMALY_DAYS} DAY""")
add_view("anomaly_parts", "anomaly_rows", """
    SELECT company_id, max(ts) AS ts, max(n) AS n_bars,
      coalesce(least(100, 20 * 100 * abs(max(close) FILTER (rn = n) - max(close) FILTER (rn = n - 1))
               / nullif(max(close) FILTER (rn = n - 1), 0)), 0)::DOUBLE AS price_change_score,
      CASE WHEN max(n) >= 21 THEN coalesce(greatest(0, least(100,
        (max(volume) FILTER (rn = n) / (sum(volume) FILTER (n - rn BETWEEN 1 AND 20) / 20.0) - 1) * 25)), 0)
        ELSE 0 END::DOUBLE AS volume_score,
      CASE WHEN max(n) >= 21 THEN coalesce(greatest(0, least(100,
        (avg(abs(close - prev) / prev) FILTER (rn BETWEEN 2 AND 6)
         / avg(abs(close - prev) / prev) FILTER (rn BETWEEN 2 AND 21) - 1) * 50)), 0)
        ELSE 0 END::DOUBLE AS volatility_score,
      CASE WHEN max(n) >= 20 THEN least(100, 12.5 * 100 * abs(max(close) FILTER (rn = n)
        / avg(close) FILTER (n - rn < 20) - 1)) ELSE 0 END::DOUBLE AS technical_score
    FROM anomaly_rows GROUP BY company_id HAVING max(n) >= 2""")
add_view("anomalies", "anomaly_parts", """
    SELECT *, price_change_score * 0.35 + volume_score * 0.25 + volatility_score * 0.20
              + technical_score * 0.20 AS overall_score FROM anomaly_parts""")
_ANOM = ["price_change_score", "volume_score", "volatility_score", "technical_score", "overall_score"]
# The data moves mildly, so the queries use a lower trigger than the default 80.
ANOMALY_TRIGGER = 25.0


@query("anomaly_scores", "G13 G14", with_views("anomalies", f"""
    SELECT company_id, {sql_day("ts")}, n_bars, {sql_rnd(*_ANOM)},
           overall_score >= {ANOMALY_TRIGGER} AS triggered FROM anomalies"""))
def anomaly_scores(m):
    return anomalies_of(m).select("company_id", day_text("ts"), "n_bars", *rnd(*_ANOM), "triggered")


def anomalies_of(m):
    from dataclasses import replace

    from tallyvane.settings import SETTINGS

    weights = replace(SETTINGS.anomaly, trigger=ANOMALY_TRIGGER)
    return anomaly.anomaly_scores(m.recent_bars(ANOMALY_DAYS), weights)


_FWD = ["return_1m", "return_3m", "return_6m"]
add_view("forward", "scores bars", """
    SELECT s.*, b.ts AS base_ts, b.close AS base_close,
           """ + ", ".join(f"""
           (SELECT CASE WHEN e.ts >= b.ts AND date_diff('second', e.ts, s.ts + INTERVAL {d} DAY) <= 5 * 86400
                        THEN (e.close - b.close) / b.close END
            FROM bars e WHERE e.company_id = s.company_id AND e.ts <= s.ts + INTERVAL {d} DAY
            ORDER BY e.ts DESC LIMIT 1) AS return_{k}""" for k, d in pricing.HORIZONS) + """
    FROM scores s ASOF JOIN bars b ON s.company_id = b.company_id AND s.ts <= b.ts
    WHERE b.close > 0""")


@query("forward_returns", "E7 E8", with_views("forward", f"""
    SELECT company_id, {sql_day("ts")}, overall_score, {sql_day("base_ts")}, base_close,
           {sql_rnd(*_FWD)} FROM forward"""))
def forward_returns(m):
    out = pricing.forward_returns(m.scores(), m.bars(), "ts")
    return out.select("company_id", day_text("ts"), "overall_score", day_text("base_ts"),
                      "base_close", *rnd(*_FWD))


@query("latest_score_at_bar", "E6", with_views("bars scores", f"""
    SELECT b.company_id, {sql_day("b.ts", "ts")}, b.close, {sql_day("s.ts", "score_ts")}, s.overall_score
    FROM bars b ASOF LEFT JOIN scores s ON b.company_id = s.company_id AND b.ts >= s.ts"""))
def latest_score_at_bar(m):
    scores = m.scores().select("company_id", F.col("ts").alias("score_ts"), "overall_score")
    out = asof.asof_join(m.bars(), scores, ["company_id"], "ts", "score_ts",
                         {"score_ts": "score_ts", "overall_score": "overall_score"})
    return out.select("company_id", day_text("ts"), "close", day_text("score_ts"), "overall_score")


@query("latest_score_at_bar_bucketed", "E6", with_views("bars scores", f"""
    SELECT b.company_id, {sql_day("b.ts", "ts")}, s.overall_score
    FROM bars b ASOF LEFT JOIN scores s ON b.company_id = s.company_id AND b.ts >= s.ts"""))
def latest_score_at_bar_bucketed(m):
    """Same join through the skew-safe time-bucketed form."""
    scores = m.scores().select("company_id", F.col("ts").alias("score_ts"), "overall_score")
    out = asof.asof_join(m.bars(), scores, ["company_id"], "ts", "score_ts",
                         {"overall_score": "overall_score"}, bucket_seconds=180 * 86400)
    return out.select("company_id", day_text("ts"), "overall_score")


@query("latest_score_rows", "E5 G23", with_views("scores", f"""
    SELECT company_id, {sql_day("ts")}, overall_score, risk_score
    FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ts DESC) = 1"""))
def latest_score_rows(m):
    return latest_per_key(m.scores(), ["company_id"], "ts").select(
        "company_id", day_text("ts"), "overall_score", "risk_score")


@query("trading_grid", "G19 H12", with_views("bars", f"""
    SELECT {sql_day("ts")}, pos, CAST(pos // 21 AS INTEGER) AS k
    FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM bars))
    WHERE pos % 21 = 0"""))
def trading_grid(m):
    return pricing.trading_grid(m.bars(), 21).select(day_text("ts"), "pos", "k")


@query("momentum_leaders", "G17 H8", with_views("bars", f"""
    SELECT {sql_day("ts")}, company_id, round(momentum, 6) AS momentum, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY momentum DESC, company_id) AS rank
          FROM (SELECT company_id, ts, (close - p) / p AS momentum
                FROM (SELECT *, lag(close, 60) OVER (PARTITION BY company_id ORDER BY ts) AS p FROM bars)
                WHERE p > 0)
          WHERE ts IN (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos
                                       FROM (SELECT DISTINCT ts FROM bars)) WHERE pos % 21 = 0))
    WHERE rank <= 5"""))
def momentum_leaders(m):
    bars = m.bars()
    out = pricing.momentum_signal(bars, 60, pricing.trading_grid(bars, 21), 5)
    return out.select(day_text("ts"), "company_id", *rnd("momentum"), "rank")


@query("trailing_volatility", "G18", with_views("bar_rows", f"""
    SELECT company_id, {sql_day("ts")},
           round(CASE WHEN count(close / prev) OVER t >= 2
                      THEN stddev_samp(close / prev - 1) OVER t * sqrt(252) ELSE 0.25 END, 6) AS volatility
    FROM bar_rows WINDOW t AS (PARTITION BY company_id ORDER BY ts ROWS 59 PRECEDING)"""))
def trailing_volatility(m):
    return pricing.trailing_volatility(m.bars(), 60).select(
        "company_id", day_text("ts"), *rnd("volatility"))


@query("market_snapshot", "F4", with_views("bar_rows", f"""
    SELECT company_id, max(close) FILTER (age = 1) AS latest_price,
           max(volume) FILTER (age = 1) AS latest_volume,
           strftime(max(ts), '%Y-%m-%d') AS latest_date,
           round((max(close) FILTER (age = 1) - max(close) FILTER (age = 2))
                 / max(close) FILTER (age = 2), 6) AS price_change_1d,
           max(high) AS price_high_30d, min(low) AS price_low_30d,
           round(avg(volume), 6) AS avg_volume_30d
    FROM bar_rows WHERE age <= 30 GROUP BY company_id"""))
def market_snapshot(m):
    return pricing.market_snapshot(m.bars()).select(
        "company_id", "latest_price", "latest_volume", day_text("latest_date"),
        *rnd("price_change_1d"), "price_high_30d", "price_low_30d", *rnd("avg_volume_30d"))
