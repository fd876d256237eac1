"""Queries behind lists, pages and the opportunity board."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd, sql_time, time_text
from tallyvane.catalog.events import market_events
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import serving as sv
from tallyvane.operators.latest import top_per_key

USER = 2

add_view("board", "companies scores analyses facts", f"""
    SELECT c.company_id, c.ticker, c.sector, coalesce(a.investment_score, s.overall_score) AS score,
           CASE WHEN a.investment_score IS NOT NULL THEN 'analysis' ELSE 'screening' END AS score_source, s.overall_score AS screening_score,
           CASE WHEN a.investment_score IS NOT NULL THEN a.risk_score ELSE s.risk_score END AS risk_score, a.analysis_id,
           CASE WHEN a.investment_score IS NOT NULL THEN a.completed_at ELSE s.ts END AS score_timestamp
    FROM companies c
    LEFT JOIN (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ts DESC) = 1) s USING (company_id)
    LEFT JOIN (SELECT analyses.* FROM analyses, facts WHERE status = 'completed' AND completed_at >= as_of AND completed_at < as_of + INTERVAL 1 DAY
               AND (user_id IS NULL OR user_id = {USER})
               QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY completed_at DESC, analysis_id DESC) = 1) a USING (company_id)
    WHERE coalesce(a.investment_score, s.overall_score) >= 0""")
_BOARD = "company_id, ticker, sector, score, score_source, screening_score, risk_score, analysis_id"


def board(m):
    scores = m.scores()
    return sv.opportunities(m.companies(), scores, m.analyses(), scores, m.now, F.lit(m.as_of + timedelta(days=1)), USER)


@query("opportunity_board", "E3 H3 H17 C21", with_views("board", f"""
    SELECT {_BOARD}, {sql_time("score_timestamp")} FROM board"""))
def opportunity_board(m):
    return board(m).select(*_BOARD.split(", "), time_text("score_timestamp"))


@query("opportunity_page", "H2 H16 H10", with_views("board", """
    SELECT company_id, score, (SELECT count(*) FROM board WHERE company_id % 7 <> 0) > 25 AS has_more FROM board WHERE company_id % 7 <> 0
    ORDER BY score DESC, company_id LIMIT 20 OFFSET 5"""))
def opportunity_page(m):
    """Second page of five onward, hiding every seventh company: a page of twenty."""
    hidden = m.companies().filter(F.col("company_id") % 7 == 0)
    rows = sv.apply_preferences(board(m), hidden)
    return sv.page(rows, [F.desc("score"), F.asc("company_id")], 20, 5).select("company_id", "score", "has_more")


@query("watched_opportunities", "H16", with_views("board", """
    SELECT company_id, score FROM board WHERE company_id % 7 <> 0 AND company_id % 2 = 0"""))
def watched_opportunities(m):
    c = m.companies()
    return sv.apply_preferences(board(m), c.filter(F.col("company_id") % 7 == 0), c.filter(F.col("company_id") % 2 == 0)).select(
        "company_id", "score")


@query("company_catalogue", "C20", with_views("companies", """
    SELECT company_id, ticker, name FROM companies WHERE (contains(lower(ticker), '#0000') OR contains(lower(name), '#0000')) AND sector = 'ASIA'
    ORDER BY ticker, company_id LIMIT 10 OFFSET 1"""))
def company_catalogue(m):
    rows = sv.search_companies(m.companies(), "#0000", "ASIA")
    return rows.orderBy("ticker", "company_id").offset(1).limit(10).select("company_id", "ticker", "name")


@query("event_list", "C22 C23 E2 H14", with_views("market_events companies", f"""
    SELECT ticker, news_id, event_type, {sql_time("event_date")} FROM market_events LEFT JOIN companies USING (company_id)
    WHERE event_type IN ('LEGAL', 'MA', 'ANALYST', 'EARNINGS_BEAT') AND (impact_score IS NULL OR impact_score >= 0.05)
    ORDER BY event_date DESC, news_id DESC LIMIT 40"""))
def event_list(m):
    ev = market_events(m).filter(F.col("event_type").isin("LEGAL", "MA", "ANALYST", "EARNINGS_BEAT")).filter(
        F.col("impact_score").isNull() | (F.col("impact_score") >= 0.05))
    rows = ev.join(m.companies(), "company_id", "left").orderBy(F.desc("event_date"), F.desc("news_id")).limit(40)
    return rows.select("ticker", "news_id", "event_type", time_text("event_date"))


@query("visible_alerts", "E13 C21", """
    SELECT event_id AS alert_id, (event_id % 4 = 0 AND user_id % 3 = 0) OR (user_id = 2 AND event_type = 'click') AS read
    FROM events WHERE event_type IN ('view', 'click') AND (event_id % 5 = 0 OR user_id = 2)""".replace(
        "(event_id % 4 = 0 AND user_id % 3 = 0)", "(event_id % 4 = 0)").replace("user_id = 2 AND event_type", "event_id % 5 <> 0 AND event_type"))
def visible_alerts(m):
    """Alerts from the event log: own ones and system ones, with receipts on every fourth."""
    e = m.table("events").filter(F.col("event_type").isin("view", "click"))
    alerts = e.select(F.col("event_id").alias("alert_id"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"),
                      (F.col("event_type") == "click").alias("is_read"))
    receipts = e.filter(F.col("event_id") % 4 == 0).select(F.col("event_id").alias("alert_id"), F.lit(USER).alias("user_id"))
    rows = alerts.filter(sv.visible_to("user_id", USER))
    return sv.with_read_flag(rows, receipts, USER).select("alert_id", "read")


@query("analysis_status_counts", "F1", with_views("analyses", """
    SELECT status, count(*) AS n FROM analyses GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM analyses"""))
def analysis_status_counts(m):
    return sv.status_counts(m.analyses())


@query("recent_news_arrays", "J25", with_views("company_news news", """
    SELECT company_id, string_agg(news_id, ',' ORDER BY published_at DESC, news_id DESC) AS news, count(*) AS n FROM (
      SELECT company_id, news_id, published_at FROM company_news JOIN news USING (news_id)
      QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, news_id DESC) <= 10) GROUP BY 1"""))
def recent_news_arrays(m):
    rows = m.company_news().join(m.news().select("news_id", "published_at", "title"), "news_id")
    r = sv.recent_items(rows, "published_at", "news_id", ["news_id", "title"])
    return r.select("company_id", F.array_join(F.transform("items", lambda x: x["news_id"].cast("string")), ",").alias("news"), "n")


@query("analysis_pages", "H10", with_views("analyses", """
    SELECT company_id, analysis_id, n > 3 AS has_more FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY completed_at DESC, analysis_id DESC) AS k, count(*) OVER (PARTITION BY company_id) AS n
      FROM analyses) WHERE k <= 3"""))
def analysis_pages(m):
    """First three analyses per company, with the look-ahead flag of each page."""
    a = m.analyses()
    first = top_per_key(a, ["company_id"], [F.desc("completed_at"), F.desc("analysis_id")], 4, rank_col="k")
    size = first.groupBy("company_id").agg(F.max("k").alias("n"))
    return first.filter("k <= 3").join(size, "company_id").select("company_id", "analysis_id", (F.col("n") > 3).alias("has_more"))
