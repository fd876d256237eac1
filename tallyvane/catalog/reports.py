"""Queries behind research context, analysis detail and job status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd
from tallyvane.catalog.prices import anomalies_of
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import with_views
from tallyvane.operators import evidence, fundamentals, linking, pricing, validation
from tallyvane.operators import serving as sv


@query("research_context", "C24", with_views("bars last_statement metrics anomalies", """
    SELECT b.company_id, round(latest, 4) AS latest_price, CASE WHEN b.company_id % 3 <> 0 THEN s.period END AS period, round(a.overall_score, 6) AS anomaly,
           concat_ws(',', CASE WHEN b.company_id % 3 = 0 THEN 'fundamental_snapshot' END, 'risk_snapshot') AS missing
    FROM (SELECT company_id, arg_max(close, ts) AS latest FROM bars GROUP BY 1) b JOIN last_statement s USING (company_id) LEFT JOIN anomalies a USING (company_id)"""))
def research_context(m):
    """Every third company lacks statements, no company has a risk section, technical is switched off."""
    stmt = fundamentals.latest_statement(m.statements()).filter(F.col("company_id") % 3 != 0).select("company_id", "period", "revenue")
    none = m.companies().filter("company_id < 0").select("company_id", F.lit(1.0).alias("risk_score"))
    ctx = sv.research_context(m.companies(), {
        "market": pricing.market_snapshot(m.bars()), "fundamental": stmt, "risk": none,
        "technical": none.withColumnRenamed("risk_score", "sma_20")})
    ctx = sv.exclude_sections(ctx, include_technical=False)
    an = anomalies_of(m).select("company_id", F.col("overall_score").alias("anomaly"))
    return ctx.join(an, "company_id", "left").select(
        "company_id", F.round("market_snapshot.latest_price", 4).alias("latest_price"),
        F.col("fundamental_snapshot.period").alias("period"), *rnd("anomaly"),
        F.array_join("missing_snapshots", ",").alias("missing"))


@query("stage_status", "", with_views("companies", """
    SELECT company_id, stage, CASE stage WHEN 'ingestion' THEN CASE company_id % 4 WHEN 0 THEN 'success' WHEN 3 THEN 'failed' ELSE 'degraded' END
             WHEN 'normalization' THEN CASE WHEN company_id % 5 = 0 THEN 'degraded' ELSE 'success' END
             WHEN 'retrieval' THEN CASE WHEN company_id % 2 = 0 THEN 'success' ELSE 'degraded' END
             WHEN 'context' THEN CASE WHEN company_id % 6 = 0 THEN 'degraded' ELSE 'success' END
             WHEN 'validation' THEN 'skipped' ELSE 'success' END AS status
    FROM companies, (VALUES (0, 'entity'), (1, 'ingestion'), (2, 'normalization'), (3, 'evidence'), (4, 'retrieval'), (5, 'context'), (6, 'validation'), (7, 'scoring')) s(i, stage)
    WHERE company_id % 4 <> 3 OR i <= 1"""))
def stage_status(m):
    k = F.col("company_id")
    flags = m.companies().select(
        "company_id", F.lit(3).alias("attempted"), (k % 4).alias("failed"), (k % 5 == 0).cast("int").alias("normalizer_errors"),
        F.lit(1).alias("n_evidence"), (k % 2 == 0).cast("int").alias("n_retrieved"), F.lit(True).alias("has_index"),
        F.when(k % 6 == 0, F.array(F.lit("risk_snapshot"))).otherwise(F.array().cast("array<string>")).alias("missing"),
        F.lit(False).alias("has_validator"), F.lit(True).alias("has_score"))
    return sv.stage_status(flags)


@query("job_freshness", "F25", """
    SELECT task, interval_minutes, age AS age_minutes, level, max(CASE level WHEN 'ok' THEN 0 WHEN 'delayed' THEN 1 ELSE 2 END) OVER () = 2 AS any_down
    FROM (SELECT *, CASE WHEN age IS NULL THEN 'down' WHEN age <= interval_minutes * 1.5 THEN 'ok' WHEN age <= interval_minutes * 3 THEN 'delayed' ELSE 'down' END AS level
      FROM (SELECT user_id::VARCHAR AS task, CASE WHEN user_id % 2 = 0 THEN 120 ELSE 60 END::INTEGER AS interval_minutes,
              round(date_diff('second', max(date_trunc('second', ts)) FILTER (event_type <> 'error'), TIMESTAMP '2024-01-31') / 60.0, 1) AS age FROM events GROUP BY user_id))""")
def job_freshness(m):
    """Every user stands for a job; errors are failures; only even jobs state a cadence."""
    ev = m.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    beats = ev.groupBy(F.col("user_id").cast("string").alias("task")).agg(
        F.max(F.when(F.col("event_type") != "error", F.date_trunc("second", "ts"))).alias("last_success_at"))
    cadence = ev.filter(F.col("user_id") % 2 == 0).select(F.col("user_id").cast("string").alias("task")).distinct().withColumn(
        "interval_minutes", F.lit(120))
    out = sv.job_freshness(beats, cadence, F.lit("2024-01-31").cast("timestamp"))
    return out.select("task", "interval_minutes", "age_minutes", "level", (F.col("overall") == "down").alias("any_down"))


@query("confidence_breakdown", "F23 D19", with_views("analyses", """
    SELECT analysis_id, round_even(d, 4) AS data, round_even(q, 4) AS quantitative, l AS llm, round_even((d + q + l) / 3, 4) AS overall
    FROM (SELECT analysis_id, coalesce(investment_score / 128, 0.5) AS d, risk_score / 128 AS q, coalesce(llm_confidence, 0.5) AS l FROM analyses)"""))
def confidence_breakdown(m):
    a = m.analyses().select("analysis_id", (F.col("investment_score") / 128).alias("d"), (F.col("risk_score") / 128).alias("q"), "llm_confidence")
    return a.select("analysis_id", *sv.confidence_breakdown("d", "q", "llm_confidence"))


@query("limitation_messages", "J27", with_views("analyses", """
    SELECT analysis_id, concat_ws(' ', CASE WHEN investment_score IS NULL THEN 'Financial coverage is unavailable for this saved analysis.' END,
             CASE WHEN investment_score IS NOT NULL AND source_count > 0 THEN 'Financial data is incomplete. Review missing inputs before relying on the score.' END,
             CASE WHEN investment_score IS NOT NULL AND source_count > 3 THEN 'Some financial scores use a neutral fallback of 50 because inputs are missing.' END,
             CASE WHEN investment_score < 50 THEN 'The financial reporting period is stale or unavailable.' END,
             CASE WHEN llm_confidence < 0.3 THEN 'Some AI statements have evidence warnings. Review their sources.' END) AS messages FROM analyses"""))
def limitation_messages(m):
    a = m.analyses().select(
        "analysis_id", F.when(F.col("investment_score") >= 50, 1.0).when(F.col("investment_score") < 50, 0.5).alias("reporting_freshness"),
        F.col("source_count").alias("n_missing"), (F.col("source_count") > 3).cast("int").alias("n_fallback"),
        (F.col("llm_confidence") < 0.3).cast("int").alias("n_warnings"))
    return a.select("analysis_id", F.array_join(sv.financial_limitations(), " ").alias("messages"))


@query("strongest_components", "H15", with_views("metrics", """
    SELECT company_id, 'Strongest measured component: ' || CASE WHEN n >= g AND n >= r THEN 'Margin' WHEN g >= r THEN 'Growth' ELSE 'Leverage' END
           || ' (' || printf('%.0f', greatest(n, g, r)) || '/100).' AS reason
    FROM (SELECT company_id, 50 + 40 * net_margin AS n, coalesce(revenue_growth, 0) * 17 AS g, debt_equity * 13 AS r FROM metrics)"""))
def strongest_components(m):
    x = fundamentals.financial_metrics(m.statements()).select(
        "company_id", (50 + 40 * F.col("net_margin")).alias("n"), (F.coalesce("revenue_growth", F.lit(0.0)) * 17).alias("g"),
        (F.col("debt_equity") * 13).alias("r"))
    return x.select("company_id", sv.strongest_component([("Margin", "n"), ("Growth", "g"), ("Leverage", "r")]).alias("reason"))


def stored_analyses(m):
    """Analyses with claims and the columns of a completed row."""
    a = m.analyses()
    claim = lambda n, v: F.struct(
        F.concat(F.lit(n), F.col("analysis_id").cast("string")).alias("claim"), F.lit("news").alias("type"),
        F.lit("wire").alias("source"), F.lit(n).alias("metric"), v.cast("double").alias("value"), F.lit("2001").alias("period"))
    return a.withColumn("claims", F.array(claim("score", F.col("investment_score")), claim("conf", F.col("llm_confidence"))))


@query("analysis_claim_rows", "B16 B17", with_views("analyses", """
    SELECT analysis_id, metric, claim, CASE WHEN v = floor(v) THEN CAST(v::BIGINT AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS value
    FROM (SELECT analysis_id, 'score' AS metric, 'score' || analysis_id AS claim, investment_score AS v FROM analyses
          UNION ALL SELECT analysis_id, 'conf', 'conf' || analysis_id, llm_confidence FROM analyses)"""))
def analysis_claim_rows(m):
    return sv.claim_rows(stored_analyses(m)).select("analysis_id", "metric", "claim", "value")


@query("completed_contract", "B18", with_views("analyses", """
    SELECT analysis_id, concat_ws('; ', CASE WHEN status <> 'completed' THEN 'status not completed' END,
             CASE WHEN investment_score IS NULL THEN 'investment_score missing' END, CASE WHEN llm_confidence IS NULL THEN 'confidence_score missing' END,
             CASE WHEN source_count = 0 THEN 'llm_model missing' END) AS errors FROM analyses
    WHERE status <> 'completed' OR investment_score IS NULL OR llm_confidence IS NULL OR source_count = 0"""))
def completed_contract(m):
    a = m.analyses().withColumns({
        "confidence_score": F.col("llm_confidence"), "llm_tokens_used": F.length("text"), "duration_seconds": F.lit(1.0),
        "analysis_version": F.lit("1"), "prompt_version": F.lit("1"), "summary": F.lit("s"),
        "llm_model": F.when(F.col("source_count") > 0, "m").otherwise(""),
        "market_snapshot": F.struct(F.lit(1).alias("x")), "risk_snapshot": F.struct(F.lit(1).alias("x"))})
    out = validation.rejected(validation.check(a, validation.completed_analysis_rules()))
    return out.select("analysis_id", F.array_join("errors", "; ").alias("errors"))


@query("payload_consistency", "D21", with_views("analyses", """
    SELECT analysis_id, concat_ws('; ', CASE WHEN analysis_id % 4 = 0 AND investment_score IS NOT NULL THEN 'score copy differs' END,
             CASE WHEN analysis_id % 3 = 0 THEN 'citation without source' END, CASE WHEN source_count > 4 THEN 'claim counts differ' END,
             CASE WHEN risk_score > investment_score + 50 THEN 'risk disproportionate' END) AS errors FROM analyses"""))
def payload_consistency(m):
    a = m.analyses().withColumns({
        "snapshot_score": F.when(F.col("analysis_id") % 4 != 0, F.col("investment_score")), "snapshot_risk": F.col("risk_score"),
        "cited": F.when(F.col("analysis_id") % 3 == 0, F.array(F.lit("news_1"), F.lit("news_9"))).otherwise(F.array(F.lit("news_1"))),
        "available": F.array(F.lit("news_1"), F.lit("events_2")),
        "stored_claims": F.col("source_count"), "payload_claims": F.least(F.col("source_count"), F.lit(4))})
    return validation.check(a, validation.payload_consistency_rules()).select(
        "analysis_id", F.array_join("errors", "; ").alias("errors"))


@query("public_payloads", "C29", with_views("analyses", """
    SELECT analysis_id, CASE WHEN investment_score IS NULL THEN 'summary' ELSE 'score,summary' END AS keys FROM analyses"""))
def public_payloads(m):
    rec = F.map_filter(F.create_map(
        F.lit("summary"), F.lit("s"), F.lit("score"), F.col("investment_score").cast("string"), F.lit("_meta"), F.lit("x"),
        F.lit("evidence"), F.lit("e"), F.lit("source_backed_claims"), F.lit("c")), lambda k, v: v.isNotNull())
    p = sv.public_payload(rec)
    return m.analyses().select("analysis_id", F.array_join(F.array_sort(F.map_keys(p)), ",").alias("keys"))


@query("observation_evidence", "C14", with_views("macro", """
    SELECT indicator, strftime(ts, '%Y-%m-%d') AS period, indicator AS metric, CAST(year(ts) AS VARCHAR) AS value, 'fred' AS source_name FROM macro"""))
def observation_evidence(m):
    data = F.parse_json(F.to_json(F.struct(F.col("indicator").alias("metric"), F.year("ts").alias("value"),
                                           F.date_format("ts", "yyyy-MM-dd").alias("period"))))
    obs = m.macro().select("indicator", F.lit("fred").alias("source"), F.lit("macro").alias("kind"), data.alias("data"),
                           F.lit(0.9).alias("confidence"))
    return evidence.observations_to_evidence(obs).select("indicator", "period", "metric", "value", "source_name")


@query("entity_links", "E17", """
    SELECT o_custkey AS source_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'cross_domain' WHEN o_orderstatus = 'O' THEN 'same_type' ELSE 'related' END AS relationship,
           count(*) AS targets FROM orders GROUP BY ALL""")
def entity_links(m):
    """Customers and their orders as candidate links of three kinds."""
    pairs = m.table("orders").select(
        F.col("o_custkey").alias("source_id"), F.lit("stock").alias("source_domain"), F.lit("company").alias("source_type"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "hr").otherwise("stock").alias("target_domain"),
        F.when(F.col("o_orderstatus") == "O", "company").otherwise("news").alias("target_type"))
    return linking.link_counts(pairs)
