"""News enrichment, event detection, materiality ranking and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import text as tx
from tallyvane.operators.pricing import with_reaction
from tallyvane.settings import SETTINGS

SCORE_COLUMNS = ("sentiment", "relevance_score", "credibility_score", "magnitude_score", "impact_score",
                 "confidence_score", "materiality_score", "effective_weight")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds the two keyword counts of a text column."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("_pos", tx.count_words_with(low, tx.POSITIVE_WORDS)).withColumn(
        "_neg", tx.count_words_with(low, tx.NEGATIVE_WORDS))


def enrich_news(news: DataFrame, as_of) -> DataFrame:
    """Fill the eight score columns of articles without a sentiment; leave the others alone.

    Relevance is taken against an empty ticker, which every text contains.
    """
    counted = word_counts(news.withColumn("_text", F.coalesce(
        F.nullif(F.col("summary"), F.lit("")), F.col("title"), F.lit(""))), "_text")
    s = tx.sentiment("_pos", "_neg")
    todo = F.col("sentiment").isNull()
    out = counted.select(
        *[c for c in news.columns if c != "sentiment"],
        F.when(todo, s["sentiment"]).otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(todo, tx.relevance("_text", F.lit(""))).alias("relevance_score"),
        F.when(todo, tx.credibility(F.coalesce("source", F.lit("")))).alias("credibility_score"),
        F.when(todo, s["magnitude"]).alias("magnitude_score"),
        F.when(todo, s["confidence"]).alias("_conf"),
    )
    out = out.withColumn("impact_score", F.bround(F.col("magnitude_score") * F.col("relevance_score"), 4))
    out = out.withColumn("confidence_score", F.bround(
        F.col("credibility_score") * 0.4 + F.col("relevance_score") * 0.3 + F.col("_conf") * 0.3, 4))
    out = out.withColumn("materiality_score", F.when(F.col("_conf").isNotNull(), tx.blended_materiality(
        F.lit("NEWS"), F.abs("sentiment"), "confidence_score")))
    decay = tx.time_decay("published_at", F.lit("NEWS"), as_of)
    return out.withColumn("effective_weight", F.when(F.col("_conf").isNotNull(), tx.effective_weight(
        "relevance_score", "credibility_score", "materiality_score", decay))).drop("_conf")


def enrich_links(news: DataFrame, links: DataFrame, companies: DataFrame) -> DataFrame:
    """Per link: relevance of the article to that company, confidence of its wording."""
    counted = word_counts(news, "summary").withColumn(
        "confidence", tx.sentiment("_pos", "_neg")["confidence"]).select("news_id", "summary", "confidence")
    return (links.select("company_id", "news_id")
            .join(companies.select("company_id", "ticker", "name"), "company_id")
            .join(counted, "news_id")
            .select("company_id", "news_id", tx.relevance("summary", "ticker", "name").alias("relevance"),
                    "confidence"))


def classify_news(news: DataFrame) -> DataFrame:
    """news plus event_type; the text itself is dropped right after.

    The type passes through ``explode(array(...))``: a later filter on it then stays
    above the classification. Pushed below, it would classify every text twice,
    lower-casing it once per phrase.
    """
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    rest = [c for c in news.columns if c != "summary"]
    return (news.withColumn("_low", low).select(*rest, tx.classify_event("_low").alias("_type"))
            .select(*rest, F.explode(F.array("_type")).alias("event_type")))


def detect_events(news: DataFrame, links: DataFrame, bars: DataFrame, as_of, since,
                  known: DataFrame | None = None,
                  min_relevance: float = SETTINGS.min_event_relevance) -> DataFrame:
    """Events from linked news, their impact corrected by the price's reaction."""
    return relabel_from_price(event_rows(news, links, as_of, since, known, min_relevance), bars)


def event_rows(news: DataFrame, links: DataFrame, as_of, since, known: DataFrame | None = None,
               min_relevance: float = SETTINGS.min_event_relevance) -> DataFrame:
    """Events from linked news as the wording tells them: gate, classify, score, weigh, dedup.

    Articles are classified once (here, unless they come with an event_type),
    before the join with their links, so only short columns are shuffled. One
    event per (company, news).
    """
    recent = news.filter(F.col("published_at") >= since)
    if "event_type" not in news.columns:
        recent = classify_news(recent)
    recent = recent.filter("event_type <> 'OTHER'")
    strong = links.filter(F.coalesce("relevance", F.lit(0.0)) >= min_relevance)
    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.7)) if "confidence" in links.columns \
        else F.lit(0.7)
    rows = strong.join(recent, "news_id").withColumn("confidence", confidence)
    rows = rows.withColumn("materiality", tx.event_materiality("event_type", "confidence"))
    cred = F.coalesce(F.nullif(F.col("credibility_score"), F.lit(0.0)), F.lit(0.7))
    rows = rows.select(
        "company_id", "news_id", "event_type", F.col("published_at").alias("event_date"),
        tx.impact_label("sentiment").alias("impact"), tx.impact_score("sentiment").alias("impact_score"),
        "confidence", "materiality",
        tx.effective_weight("relevance", cred, "materiality",
                            tx.time_decay("published_at", "event_type", as_of)).alias("effective_weight"),
        F.col("title").alias("description"))
    rows = rows.dropDuplicates(["company_id", "news_id"])
    if known is not None:
        rows = rows.join(known.select("company_id", "news_id"), ["company_id", "news_id"], "left_anti")
    return rows


def relabel_from_price(events: DataFrame, bars: DataFrame, min_materiality: float = 0.5) -> DataFrame:
    """Material events take impact and score from the realised move when there is one."""
    moved = F.when((F.col("materiality") >= min_materiality) & F.col("reacted"),
                   F.coalesce("price_change", F.lit(0.0)))
    out = with_reaction(events, bars, "event_date").withColumn("_chg", moved)
    return out.withColumn(
        "impact", F.when(F.col("_chg") >= 0.03, "positive").when(F.col("_chg") <= -0.03, "negative")
        .otherwise(F.col("impact"))
    ).withColumn(
        "impact_score", F.coalesce(F.least(F.lit(1.0), F.abs("_chg") * 10), F.col("impact_score"))
    ).select(*events.columns)


def rank_by_materiality(events: DataFrame, as_of) -> DataFrame:
    """Recomputed materiality, decay and weight; order by weight is left to the reader."""
    magnitude = F.coalesce(F.abs("sentiment"), F.lit(0.0))
    decay = tx.time_decay("event_date", "event_type", as_of)
    out = events.filter("event_date IS NOT NULL").withColumn("materiality_score", tx.blended_materiality(
        "event_type", magnitude, F.coalesce("confidence", F.lit(0.5))))
    return out.withColumn("effective_weight", tx.effective_weight(
        F.coalesce("relevance", F.lit(0.5)), F.coalesce("credibility", F.lit(0.7)), "materiality_score", decay)
    ).withColumn("time_decay", F.bround(decay, 4))


def anomaly_alerts(anomalies: DataFrame, companies: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts of all triggered anomalies that have none yet."""
    top = (anomalies.filter("triggered").join(companies.select("company_id", "ticker"), "company_id"))
    fresh = top.join(alerts.filter("alert_type = 'PRICE_ANOMALY'").select(
        "company_id", F.col("source_id").alias("anomaly_id")), ["company_id", "anomaly_id"], "left_anti")
    return fresh.select(
        "company_id", F.lit("PRICE_ANOMALY").alias("alert_type"), F.col("anomaly_id").alias("source_id"),
        F.when(F.col("overall_score") >= 80, "high").otherwise("medium").alias("severity"),
        F.format_string("%s price anomaly detected (score %.0f)", "ticker", "overall_score").alias("message"))


def event_alerts(events: DataFrame, companies: DataFrame, alerts: DataFrame, min_weight: float = 0.4,
                 shown: int | None = None) -> DataFrame:
    """Alerts of all weighty events that have none yet; ``shown`` may cut the description in the message."""
    description = F.coalesce("description", F.lit(""))
    top = (events.filter(F.col("effective_weight") >= min_weight)
           .join(companies.select("company_id", "ticker"), "company_id"))
    fresh = top.join(alerts.filter("alert_type = 'MARKET_EVENT'").select(
        "company_id", F.col("source_id").alias("event_id")), ["company_id", "event_id"], "left_anti")
    return fresh.select(
        "company_id", F.lit("MARKET_EVENT").alias("alert_type"), F.col("event_id").alias("source_id"),
        F.when(F.col("impact") == "negative", "high").otherwise("medium").alias("severity"),
        F.format_string("%s: %s (%s)", "ticker", "event_type",
                        F.substring(description, 1, shown) if shown else description).alias("message"))
