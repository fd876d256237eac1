"""Headline queries, timed one by one; prints one JSON line.

env: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_ONLY (names).
"""

from __future__ import annotations

import json
import os
import time

from tallyvane.catalog.registry import load_all
from tallyvane.session import local_session

HEADLINE = [
    "top_movers", "technical_indicators", "rolling_bands", "quote_change", "anomaly_scores", "risk_metrics",
    "market_beta", "forward_returns", "latest_score_at_bar", "momentum_leaders", "financial_metrics",
    "merged_statements", "filing_statements", "vendor_paged_bars", "bar_upsert_counts", "news_insert_survivors",
    "resolve_companies", "macro_snapshot", "source_agreement", "text_sentiment", "event_classes", "threat_screen",
    "sanitized_pages", "linked_news", "supported_citations", "detected_events", "investment_scores",
    "vector_search", "keyword_search", "hybrid_search", "portfolio_allocations", "portfolio_summaries",
    "equal_weight_performance", "momentum_position_sizes", "evaluated_scores", "opportunity_board", "over_quota",
    "streamed_ingest",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    catalog = load_all()
    names = os.environ.get("BENCH_ONLY", "").split() or HEADLINE
    catalog["top_movers"].run(spark, directory).write.format("noop").mode("overwrite").save()  # start-up cost
    times: dict[str, float] = {}
    for name in names:
        spark.catalog.clearCache()
        start = time.perf_counter()
        try:
            catalog[name].run(spark, directory).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # noqa: BLE001 - a failing query must not hide the others
            times[name] = -1.0
            print(f"# {name}: {str(exc)[:200]}", flush=True)
    total = round(sum(t for t in times.values() if t > 0), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": directory.rstrip("/").rsplit("/sf", 1)[-1]}))


if __name__ == "__main__":
    main()
