"""News to articles, links, events and alerts: one commit per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.operators import events
from tallyvane.operators.materialize import stored
from tallyvane.plans import jobs
from tallyvane.sources.store import Store

_ARTICLE = ("news_id bigint, source string, external_id string, title string, summary string, url string, published_at timestamp, "
            "sentiment double, relevance_score double, credibility_score double, magnitude_score double, impact_score double, "
            "confidence_score double, materiality_score double, effective_weight double, content_hash string")
TABLES = {
    "articles": _ARTICLE,
    "links": "company_id bigint, news_id bigint, relevance double, method string",
    "events": ("company_id bigint, news_id bigint, event_type string, event_date timestamp, impact string, impact_score double, "
               "confidence double, materiality double, effective_weight double, description string"),
    "alerts": "company_id bigint, alert_type string, source_id bigint, severity string, message string",
}


def news_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES)


def process(store: Store, raw_items: DataFrame, companies: DataFrame, bars: DataFrame, as_of, since, min_weight: float = 0.4) -> dict[str, DataFrame]:
    """All rows that a batch of raw items adds: valid new articles, their links, events found in them, alerts of weighty ones.

    ``raw_items`` as for ``jobs.process_news``. Stored events and alerts are anti-joined by key, so an article that comes again adds none.
    """
    enriched, links = jobs.process_news(raw_items, store.read("articles"), companies, as_of)
    enriched, links = stored(enriched, "new-articles"), stored(links, "new-links")
    found = stored(events.detect_events(enriched, links, bars, as_of, since, known=store.read("events")), "new-events")
    alerts = events.event_alerts(found.withColumn("event_id", F.col("news_id")), companies, store.read("alerts"), min_weight)
    return {"articles": enriched, "links": links, "events": found, "alerts": alerts}


def news_batch(root: str, inputs: Callable[[DataFrame], tuple], job: str = "news", min_weight: float = 0.4):
    """foreachBatch handler; ``inputs(batch)`` gives (raw items, companies, bars, as_of, since) in the batch's session.

    The commit is named by the epoch: four sinks change at once, and a replayed epoch changes none.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        store = news_store(batch.sparkSession, root)
        store.commit(f"{job}-{epoch:012d}", job, lambda: process(store, *inputs(batch), min_weight=min_weight))

    return handle
