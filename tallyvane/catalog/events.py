"""Queries over news scores, detected events and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd, sql_rnd, sql_time, time_text
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.catalog.prices import ANOMALY_TRIGGER, anomalies_of
from tallyvane.catalog.text import sql_classify, sql_cred, sql_decay, sql_weight
from tallyvane.operators import events, pricing

EVENT_DAYS = 170

add_view("news_parts", "news doc_sentiment facts", f"""
    SELECT n.* EXCLUDE (sentiment), n.sentiment AS given, coalesce(n.sentiment, d.sentiment) AS sentiment,
           CASE WHEN n.sentiment IS NULL THEN 0.95 END::DOUBLE AS relevance_score,
           CASE WHEN n.sentiment IS NULL THEN {sql_cred("n.source")} END::DOUBLE AS credibility_score,
           CASE WHEN n.sentiment IS NULL THEN magnitude END AS magnitude_score, confidence AS c
    FROM news n JOIN doc_sentiment d ON doc_id = news_id""")
add_view("news_parts2", "news_parts", """
    SELECT *, round_even(magnitude_score * relevance_score, 4) AS impact_score,
           round_even(credibility_score * 0.4::DOUBLE + relevance_score * 0.3::DOUBLE + c * 0.3::DOUBLE, 4) AS confidence_score
    FROM news_parts""")
add_view("news_parts3", "news_parts2", """
    SELECT *, CASE WHEN given IS NULL THEN round_even(0.2::DOUBLE * (0.6::DOUBLE + 0.2::DOUBLE * abs(sentiment)
                   + 0.2::DOUBLE * confidence_score), 4) END AS materiality_score FROM news_parts2""")
add_view("news_scored", "news_parts3 facts", f"""
    SELECT *, CASE WHEN given IS NULL THEN round_even(relevance_score * credibility_score * materiality_score
                   * {sql_decay("published_at", "'NEWS'")}, 4) END AS effective_weight
    FROM news_parts3, facts""")
add_view("events_raw", "news_scored company_news facts", f"""
    SELECT company_id, news_id, event_type, published_at AS event_date,
           CASE WHEN sentiment > 0.2 THEN 'positive' WHEN sentiment < -0.2 THEN 'negative' ELSE 'neutral' END AS impact,
           round_even(least(1.0::DOUBLE, abs(sentiment)), 4) AS impact_score, 0.7::DOUBLE AS confidence, materiality,
           round_even(relevance * coalesce(credibility_score, 0.7::DOUBLE) * materiality
                      * {sql_decay("published_at", "event_type")}, 4) AS effective_weight, title AS description
    FROM (SELECT *, round_even(({sql_weight("event_type")})::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * 0.7::DOUBLE), 4) AS materiality
          FROM (SELECT news_id, title, sentiment, credibility_score, published_at, {sql_classify("t")} AS event_type
                FROM (SELECT *, lower(title || ' ' || summary) AS t FROM news_scored))
          WHERE event_type <> 'OTHER'), company_news c, facts
    WHERE c.news_id = news_scored_id AND relevance >= 0.8 AND published_at >= as_of - INTERVAL {EVENT_DAYS} DAY
    """.replace("SELECT news_id, title, sentiment", "SELECT news_id AS news_scored_id, title, sentiment")
       .replace("company_id, news_id, event_type", "company_id, c.news_id, event_type"))
add_view("reactions", "events_raw bars", """
    SELECT e.company_id, e.news_id, e.event_date, b.close AS price_before, a.close AS price_after,
           (a.close - b.close) / b.close AS price_change, (a.volume - b.volume) / nullif(b.volume, 0) AS volume_change,
           CAST(floor(date_diff('second', e.event_date, a.ts) / 60) AS BIGINT) AS minutes_to_reaction
    FROM events_raw e
    ASOF JOIN bars b ON b.company_id = e.company_id AND e.event_date >= b.ts
    ASOF JOIN bars a ON a.company_id = e.company_id AND e.event_date + INTERVAL 1 DAY <= a.ts""")
add_view("market_events", "events_raw reactions", """
    SELECT e.* EXCLUDE (impact, impact_score),
           CASE WHEN price_change >= 0.03 THEN 'positive' WHEN price_change <= -0.03 THEN 'negative' ELSE impact END AS impact,
           coalesce(least(1.0::DOUBLE, abs(price_change) * 10), impact_score) AS impact_score
    FROM events_raw e LEFT JOIN (SELECT r.* FROM reactions r JOIN events_raw x USING (company_id, news_id)
                                 WHERE x.materiality >= 0.5) r USING (company_id, news_id)""")


def scored_news(m):
    return events.enrich_news(m.news(), m.now)


def market_events(m, days: int = EVENT_DAYS, news=None):
    # bars a little older than the oldest event, for the price before it
    from datetime import timedelta

    bars = m.bars(since=m.as_of - timedelta(days=EVENT_DAYS + 400))
    return events.detect_events(scored_news(m) if news is None else news, m.company_news(), bars, m.now, m.days_ago(days))


_NEWS = ["sentiment", "relevance_score", "credibility_score", "magnitude_score", "impact_score", "confidence_score",
         "materiality_score", "effective_weight"]


@query("enriched_news", "J5 J4 J9", with_views("news_scored", f"""
    SELECT news_id, {", ".join(_NEWS)} FROM news_scored"""))
def enriched_news(m):
    return scored_news(m).select("news_id", *_NEWS)


@query("enriched_links", "J28", with_views("news companies company_news doc_sentiment", """
    SELECT company_id, news_id, confidence,
           CASE WHEN contains(lower(summary), lower(ticker)) THEN 0.95 WHEN contains(lower(summary), lower(name)) THEN 0.90
                WHEN contains(lower(summary), lower(name)) THEN 0.6 ELSE 0.3 END::DOUBLE AS relevance
    FROM company_news JOIN news USING (news_id) JOIN companies USING (company_id) JOIN doc_sentiment ON doc_id = news_id"""))
def enriched_links(m):
    return events.enrich_links(m.news(), m.company_news(), m.companies())


_EV = ["impact", "confidence", "materiality", "effective_weight", "description"]


@query("detected_events", "J10 J7 J8 J11 B7", with_views("market_events", f"""
    SELECT company_id, news_id, event_type, {sql_time("event_date")}, round(impact_score, 6) AS impact_score,
           {", ".join(_EV)} FROM market_events"""))
def detected_events(m):
    return market_events(m).select("company_id", "news_id", "event_type", time_text("event_date"),
                                   *rnd("impact_score"), *_EV)


@query("new_events_only", "B7", with_views("market_events", """
    SELECT company_id, news_id FROM market_events WHERE news_id % 3 <> 0"""))
def new_events_only(m):
    """A third of the events is stored already; only the others are inserted."""
    known = m.company_news().filter(F.col("news_id") % 3 == 0)
    out = events.detect_events(scored_news(m), m.company_news(), m.recent_bars(EVENT_DAYS + 400), m.now,
                               m.days_ago(EVENT_DAYS), known=known)
    return out.select("company_id", "news_id")


_RX = ["price_change", "volume_change"]


@query("event_price_reactions", "E9", with_views("reactions", f"""
    SELECT company_id, news_id, price_before, price_after, {sql_rnd(*_RX)}, minutes_to_reaction FROM reactions"""))
def event_price_reactions(m):
    ev = market_events(m).select("company_id", "news_id", "event_date")
    out = pricing.price_reaction(ev, m.recent_bars(EVENT_DAYS + 400), "event_date")
    return out.select("company_id", "news_id", "price_before", "price_after", *rnd(*_RX), "minutes_to_reaction")


@query("materiality_ranking", "H9 J9", with_views("events_raw news_scored facts", f"""
    SELECT company_id, news_id, materiality_score, round_even(decay, 4) AS time_decay,
           round_even(0.85::DOUBLE * 0.6::DOUBLE * materiality_score * decay, 4) AS effective_weight
    FROM (SELECT e.company_id, e.news_id, {sql_decay("event_date", "event_type")} AS decay,
                 round_even(({sql_weight("event_type")})::DOUBLE * (0.6::DOUBLE + 0.2::DOUBLE * abs(n.sentiment) + 0.2::DOUBLE * 0.5::DOUBLE), 4) AS materiality_score
          FROM events_raw e JOIN news_scored n USING (news_id))"""))
def materiality_ranking(m):
    """Weight of every event of every company, from classified articles and their links."""
    news = events.classify_news(scored_news(m)).filter("event_type <> 'OTHER'").filter(
        F.col("published_at") >= m.days_ago(EVENT_DAYS))
    links = m.company_news().filter("relevance >= 0.8").select("company_id", "news_id")
    rows = links.join(news, "news_id").select(
        "company_id", "news_id", "event_type", F.col("published_at").alias("event_date"), "sentiment",
        F.lit(0.5).alias("confidence"), F.lit(0.85).alias("relevance"), F.lit(0.6).alias("credibility"))
    return events.rank_by_materiality(rows, m.now).select(
        "company_id", "news_id", "materiality_score", "time_decay", "effective_weight")


def stored_alerts(m):
    """Alerts that exist already: every fourth company's anomaly, every fifth article's event."""
    comp = m.companies().select("company_id", F.lit("PRICE_ANOMALY").alias("alert_type"),
                                F.col("company_id").alias("source_id")).filter(F.col("company_id") % 4 == 0)
    ev = m.company_news().filter("relevance >= 0.8").select(
        "company_id", F.lit("MARKET_EVENT").alias("alert_type"), F.col("news_id").alias("source_id")).filter(
        F.col("source_id") % 5 == 0)
    return comp.unionByName(ev)


@query("anomaly_alerts", "J12 E12", with_views("anomalies companies", f"""
    SELECT company_id, 'PRICE_ANOMALY' AS alert_type, company_id AS source_id,
           CASE WHEN overall_score >= 80 THEN 'high' ELSE 'medium' END AS severity,
           ticker || ' price anomaly detected (score ' || printf('%.0f', overall_score) || ')' AS message
    FROM (SELECT * FROM anomalies JOIN companies USING (company_id) WHERE overall_score >= {ANOMALY_TRIGGER}
          ORDER BY ts DESC, company_id DESC) WHERE company_id % 4 <> 0"""))
def anomaly_alerts(m):
    an = anomalies_of(m).withColumn("anomaly_id", F.col("company_id"))
    return events.anomaly_alerts(an, m.companies(), stored_alerts(m))


@query("event_alerts", "J12 E12 E2", with_views("market_events companies", """
    SELECT company_id, 'MARKET_EVENT' AS alert_type, news_id AS source_id,
           CASE WHEN impact = 'negative' THEN 'high' ELSE 'medium' END AS severity,
           ticker || ': ' || event_type || ' (' || description || ')' AS message
    FROM (SELECT * FROM market_events JOIN companies USING (company_id) WHERE effective_weight >= 0.2
          ORDER BY event_date DESC, news_id DESC) WHERE news_id % 5 <> 0"""))
def event_alerts(m):
    # weight limit 0.2 instead of 0.4: unknown sources carry a credibility of 0.6
    ev = market_events(m).withColumn("event_id", F.col("news_id"))
    return events.event_alerts(ev, m.companies(), stored_alerts(m), min_weight=0.2)
