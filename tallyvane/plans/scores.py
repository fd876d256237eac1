"""Quality and investment scores of every company as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators import fundamentals as fund
from tallyvane.operators import macro as mac
from tallyvane.operators import quality, scoring
from tallyvane.settings import SETTINGS


def financial_inputs(companies: DataFrame, metrics: DataFrame, statements: DataFrame, as_of) -> DataFrame:
    """Completeness columns per company, from the newest metrics and statement."""
    last = fund.latest_statement(statements).select("company_id", F.col("period").alias("reporting_period"))
    joined = (companies.select("company_id").join(metrics.drop("period"), "company_id", "left")
              .join(last, "company_id", "left")
              .withColumn("metrics_ts", F.when(F.col("roe").isNotNull() | F.col("net_margin").isNotNull(), as_of)))
    return fund.financial_completeness(joined, as_of)


def quality_of(companies: DataFrame, bars: DataFrame, technical: DataFrame, news: DataFrame, links: DataFrame,
               events: DataFrame, financial: DataFrame, as_of) -> DataFrame:
    days = SETTINGS.full_data_days
    linked = links.select("company_id", "news_id").join(news.select("news_id", "published_at"), "news_id")
    parts = {
        "price": quality.recency(bars, "ts", days["price"], as_of, "price"),
        "technical": quality.recency(technical, "ts", days["technical"], as_of, "technical"),
        "news": quality.recency(linked, "published_at", days["news"], as_of, "news"),
        "events": quality.recency(events, "event_date", days["events"], as_of, "events"),
    }
    return quality.assess(companies, parts, financial)


def score_companies(companies: DataFrame, statements: DataFrame, metrics: DataFrame, technical: DataFrame,
                    risk: DataFrame, bars: DataFrame, news: DataFrame, links: DataFrame, events: DataFrame,
                    macro: DataFrame, as_of) -> DataFrame:
    """Investment scores; every input is keyed by company or tiny."""
    ago = lambda d: F.timestamp_seconds(F.unix_timestamp(as_of) - d * 86400)
    financial = financial_inputs(companies, metrics, statements, as_of)
    q = quality_of(companies, bars, technical, news, links, events, financial, as_of)
    regime = mac.macro_snapshot(macro, as_of).select("economic_regime").scalar()
    return scoring.investment_scores(
        companies, metrics, technical, scoring.sentiment_scores(news, links, ago(7)),
        scoring.catalyst_scores(events, ago(30)), risk, q, regime)
