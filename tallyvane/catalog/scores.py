"""Queries over data quality and investment scores."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd, sql_rnd
from tallyvane.catalog.events import EVENT_DAYS, market_events, scored_news
from tallyvane.catalog.prices import TECH_DAYS
from tallyvane.catalog.registry import query
from tallyvane.catalog.risk import risk_of
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import fundamentals as fund
from tallyvane.operators import events, indicators, scoring
from tallyvane.operators.materialize import stored
from tallyvane.plans import scores as plan
from tallyvane.settings import SETTINGS
from tallyvane.sources.views import Market

_F = fund.COMPONENT_FIELDS


def _missing(fields, alias):
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {f} IS NULL THEN '{f}' END" if f not in ("pe_ratio", "ps_ratio", "pb_ratio") else f"'{f}'"
        for f in fields) + f"], lambda x: x IS NOT NULL), ',') AS {alias}"


add_view("financial", "companies metrics last_statement facts", f"""
    SELECT *, (cf + cv + cg) / 3 * fresh AS financial_quality,
           array_to_string(list_filter([CASE WHEN cf = 0 THEN 'fundamental' END, CASE WHEN cv = 0 THEN 'valuation' END,
                                        CASE WHEN cg = 0 THEN 'growth' END], lambda x: x IS NOT NULL), ',') AS fallback FROM (
      SELECT c.company_id, m.* EXCLUDE (company_id, period),
             ((roe IS NOT NULL)::INT + (net_margin IS NOT NULL)::INT + (roa IS NOT NULL)::INT + (debt_equity IS NOT NULL)::INT) / 4.0 AS cf,
             least(1.0, (fcf_yield IS NOT NULL)::INT / 3)::DOUBLE AS cv,
             ((revenue_growth IS NOT NULL)::INT + (earnings_growth IS NOT NULL)::INT + (fcf_growth IS NOT NULL)::INT) / 3 AS cg,
             CASE WHEN date_diff('day', CAST(s.period AS DATE), CAST(as_of AS DATE)) BETWEEN 0 AND 150 THEN 1.0
                  WHEN date_diff('day', CAST(s.period AS DATE), CAST(as_of AS DATE)) BETWEEN 151 AND 400 THEN 0.5 ELSE 0.0 END::DOUBLE AS fresh,
             {_missing(_F["fundamental"], "missing_fundamental")}, {_missing(_F["valuation"], "missing_valuation")},
             {_missing(_F["growth"], "missing_growth")}
      FROM companies c LEFT JOIN metrics m USING (company_id) LEFT JOIN last_statement s USING (company_id), facts)""")
add_view("quality", "financial bars technical news company_news market_events facts", """
    SELECT *, price * 0.30::DOUBLE + technical * 0.15::DOUBLE + news * 0.15::DOUBLE + events * 0.10::DOUBLE + fundamental * 0.30::DOUBLE AS overall_raw
    FROM (SELECT f.company_id, f.fallback, coalesce(financial_quality, 0)::DOUBLE AS fundamental,
      coalesce((SELECT CASE WHEN max(ts) >= any_value(as_of) - INTERVAL 30 DAY THEN 1.0 ELSE 0.5 END FROM bars b, facts
                WHERE b.company_id = f.company_id GROUP BY b.company_id), 0)::DOUBLE AS price,
      coalesce((SELECT CASE WHEN max(ts) >= any_value(as_of) - INTERVAL 30 DAY THEN 1.0 ELSE 0.5 END FROM technical b, facts
                WHERE b.company_id = f.company_id GROUP BY b.company_id), 0)::DOUBLE AS technical,
      coalesce((SELECT CASE WHEN max(published_at) >= any_value(as_of) - INTERVAL 7 DAY THEN 1.0 ELSE 0.5 END
                FROM (SELECT company_id, published_at FROM company_news JOIN news USING (news_id)) b, facts
                WHERE b.company_id = f.company_id GROUP BY b.company_id), 0)::DOUBLE AS news,
      coalesce((SELECT CASE WHEN max(event_date) >= any_value(as_of) - INTERVAL 30 DAY THEN 1.0 ELSE 0.5 END FROM market_events b, facts
                WHERE b.company_id = f.company_id GROUP BY b.company_id), 0)::DOUBLE AS events
    FROM financial f)""")


def _mean(parts, default=50.0):
    return (f"coalesce(list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), {default})::DOUBLE")


def _b(x):
    return f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


add_view("components", "financial technical risk quality regimes news_scored company_news market_events facts", f"""
    SELECT f.company_id, q.overall_raw, q.fallback, regime,
      {_b(_mean(["least(100, f.roe * 100 / 0.30::DOUBLE)", "least(100, f.net_margin * 100 / 0.20::DOUBLE)", "least(100, f.roa * 100 / 0.15::DOUBLE)", f"100 - {_b('f.debt_equity / 2 * 100')}"]))} AS fundamental,
      {_b(_mean(["greatest(0, least(100, f.fcf_yield * 10))"]))} AS valuation,
      {_b(_mean(["greatest(0, least(100, f.revenue_growth * 100 / 0.30::DOUBLE))", "greatest(0, least(100, f.earnings_growth * 100 / 0.40::DOUBLE))", "greatest(0, least(100, f.fcf_growth * 100 / 0.30::DOUBLE))"]))} AS growth,
      {_b(_mean(["CASE WHEN t.rsi_14 < 30 THEN 70 WHEN t.rsi_14 > 70 THEN 40 WHEN t.rsi_14 IS NOT NULL THEN 55 END::DOUBLE", "greatest(0, least(100, 50 + t.momentum))", f"100 - {_b('t.drawdown / 0.3::DOUBLE * 100')}"]))} AS technical,
      coalesce((SELECT (avg(sentiment) + 1) * 50 FROM company_news c JOIN news_scored n USING (news_id)
                WHERE c.company_id = f.company_id AND n.published_at >= n.as_of - INTERVAL 7 DAY), 50)::DOUBLE AS sentiment,
      coalesce((SELECT {_b("50 + 10.0 * sum(CASE impact WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END)")} FROM market_events e, facts
                WHERE e.company_id = f.company_id AND event_date >= as_of - INTERVAL 30 DAY), 50)::DOUBLE AS catalyst,
      coalesce(r.risk_score, 50)::DOUBLE AS risk, r.volatility
    FROM financial f LEFT JOIN technical t USING (company_id) LEFT JOIN risk r USING (company_id)
    JOIN quality q USING (company_id), regimes""")
_levels = " ".join(f"WHEN overall >= {lv} THEN '{n}'" for lv, n in SETTINGS.recommendation)
add_view("gold_scores", "components", f"""
    SELECT *, CASE {_levels} ELSE 'AVOID' END AS recommendation FROM (
      SELECT *, {_b("fundamental * 0.30::DOUBLE + valuation * 0.20::DOUBLE + growth * 0.15::DOUBLE + technical * 0.10::DOUBLE + sentiment * 0.10::DOUBLE + catalyst * 0.10::DOUBLE - risk * 0.15::DOUBLE")} AS overall,
             greatest(0, CASE WHEN regime IN ('contraction_risk', 'high_volatility') THEN -0.05 ELSE 0 END
               + round_even(least(CASE WHEN overall_raw < 0.4 OR fallback <> '' THEN 0.5 ELSE 0.95 END, round_even(overall_raw, 4)), 4))::DOUBLE AS confidence
      FROM components)""")


def technical_of(m):
    return indicators.technical_indicators(m.recent_bars(TECH_DAYS))


def once(m):
    """The market with its bars (of the longest window that a score reads) and statements written once."""
    other = Market(m.spark, m.directory)
    other.as_of, other.n_companies = m.as_of, m.n_companies
    bars = stored(m.recent_bars(TECH_DAYS), "score-bars")
    statements = stored(m.statements(), "score-statements")

    def window(since=None, until=None):
        if since is None or since < m.as_of - timedelta(days=TECH_DAYS):
            return m.bars(since, until)
        rows = bars.filter(F.col("ts") >= F.lit(since))
        return rows if until is None else rows.filter(F.col("ts") < F.lit(until + timedelta(days=1)))

    other.bars, other.statements = window, lambda: statements
    return other


def inputs(m):
    """The gold inputs of the score plan, each built once: one scan of the trades for bars, one for statements, one for their days.

    Everything with several readers is a table in the shared folder, so nothing stays cached behind a query.
    """
    m = once(m)
    # articles are scored and classified once and kept without their text
    news = stored(events.classify_news(scored_news(m)), "score-news")
    ev = stored(market_events(m, news=news), "score-events")
    return {
        "companies": m.companies(), "statements": m.statements(), "metrics": fund.financial_metrics(m.statements()),
        "technical": technical_of(m), "risk": risk_of(m, ev), "bars": m.trade_days(), "news": news,
        "links": m.company_news(), "events": ev, "macro": m.macro(), "as_of": m.now,
    }


def gold_scores(m):
    return plan.score_companies(**inputs(m))


@query("financial_quality", "D12 D13", with_views("financial", """
    SELECT company_id, round(cf, 6)::DOUBLE AS coverage_fundamental, round(cv, 6)::DOUBLE AS coverage_valuation, round(cg, 6)::DOUBLE AS coverage_growth,
           missing_fundamental, missing_valuation, missing_growth, fallback, fresh AS reporting_freshness,
           round(financial_quality, 6)::DOUBLE AS financial_quality FROM financial"""))
def financial_quality(m):
    out = plan.financial_inputs(m.companies(), fund.financial_metrics(m.statements()), m.statements(), m.now)
    names = list(_F)
    return out.select(
        "company_id", *[F.round(f"coverage_{n}", 6).alias(f"coverage_{n}") for n in names],
        *[F.array_join(f"missing_{n}", ",").alias(f"missing_{n}") for n in names],
        F.array_join("fallback_components", ",").alias("fallback"), "reporting_freshness", *rnd("financial_quality"))


@query("data_quality", "D11 D14", with_views("quality", """
    SELECT company_id, price, technical, news, events, round(fundamental, 6) AS fundamental, round(overall_raw, 4) AS quality,
           overall_raw >= 0.4 AS sufficient FROM quality"""))
def data_quality(m):
    """Quality asks when a source has rows, not what they say: no bar is written, no text scored, no reaction looked up."""
    statements = stored(m.statements(), "quality-statements")
    fin = plan.financial_inputs(m.companies(), fund.financial_metrics(statements), statements, m.now)
    found = events.event_rows(scored_news(m), m.company_news(), m.now, m.days_ago(EVENT_DAYS))
    q = plan.quality_of(m.companies(), m.trade_days(), technical_of(m), m.news(), m.company_news(), found, fin, m.now)
    return q.select("company_id", "price", "technical", "news", "events", *rnd("fundamental"), "quality", "sufficient")


_PARTS = list(scoring.COMPONENTS)


@query("component_scores", "J13 J14 J15 F6 F8", with_views("components", f"""
    SELECT company_id, {sql_rnd(*_PARTS)}, round(volatility, 6) AS volatility FROM components"""))
def component_scores(m):
    return gold_scores(m).select("company_id", *rnd(*_PARTS, "volatility"))


@query("investment_scores", "J16 J17 J18 D15 N2", with_views("gold_scores", """
    SELECT company_id, round(overall, 6) AS overall, round(confidence, 4) AS confidence, recommendation,
           concat_ws('; ', CASE WHEN overall >= 70 AND confidence < 0.5 THEN 'High overall score with low confidence without data quality warning' END,
             CASE WHEN overall_raw < 0.4 AND recommendation IN ('STRONG_OPPORTUNITY', 'OPPORTUNITY') THEN 'strong recommendation issued with insufficient data quality' END,
             CASE WHEN risk > overall + 50 THEN 'Risk score is disproportionately high vs overall' END) AS issues
    FROM gold_scores"""))
def investment_scores(m):
    return gold_scores(m).select("company_id", *rnd("overall"), F.round("confidence", 4).alias("confidence"),
                                 "recommendation", F.array_join("issues", "; ").alias("issues"))


@query("score_records", "J21", with_views("gold_scores companies", f"""
    SELECT ticker, round(overall, 6) AS score, recommendation, {sql_rnd(*_PARTS)}, 'investment_score_v1' AS scoring_model, '1.0' AS scoring_version
    FROM gold_scores JOIN companies USING (company_id)"""))
def score_records(m):
    r = scoring.score_record(gold_scores(m), m.companies())
    return r.select("ticker", *rnd("score"), "recommendation",
                    *[F.round(f"components.{c}", 6).alias(c) for c in _PARTS], "scoring_model", "scoring_version")


@query("recommendation_ladder", "J17", with_views("scores", f"""
    SELECT recommendation, count(*) AS n, count(*) FILTER (recommendation IN ('STRONG_OPPORTUNITY', 'OPPORTUNITY')) AS strong
    FROM (SELECT CASE {_levels.replace("overall", "overall_score")} ELSE 'AVOID' END AS recommendation FROM scores) GROUP BY 1"""))
def recommendation_ladder(m):
    r = m.scores().select(scoring.recommendation("overall_score").alias("recommendation"))
    strong = F.count(F.when(F.col("recommendation").isin(*scoring.strong_categories()), 1))
    return r.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"), strong.alias("strong"))


@query("product_scores", "J20", """
    SELECT p_partkey AS product_id, round(t, 1) AS score, 0.7::DOUBLE AS confidence,
           CASE WHEN t >= 80 THEN 'STRONG_BUY' WHEN t >= 60 THEN 'BUY' WHEN t >= 40 THEN 'HOLD' ELSE 'AVOID' END AS recommendation,
           round(p, 1) AS price_competitiveness
    FROM (SELECT *, (p_size * 2.0)::DOUBLE * 0.4::DOUBLE + 50.0::DOUBLE * 0.3::DOUBLE + p * 0.3::DOUBLE AS t FROM (
      SELECT p_partkey, p_size, greatest(0.0, least(100.0, 100 - p_retailprice / 10.37 / 2)) AS p FROM part))""")
def product_scores(m):
    p = m.table("part").select(
        F.col("p_partkey").alias("product_id"), (F.col("p_size") * 2.0).alias("quality_score"),
        F.lit(None).cast("double").alias("demand_score"), (F.col("p_retailprice") / 10.37).alias("price"))
    return scoring.product_scores(p)
