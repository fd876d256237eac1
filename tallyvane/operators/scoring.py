"""Investment score: components, total, confidence, recommendation and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.numeric import bounded_score, clamp, mean_present, normalize_range
from tallyvane.settings import SETTINGS

COMPONENTS = ("fundamental", "valuation", "growth", "technical", "sentiment", "catalyst", "risk")
_c = F.col


def fundamental_score() -> Column:
    cap = lambda c, full: F.least(F.lit(100.0), _c(c) * 100 / full)
    return mean_present([
        F.when(_c("roe").isNotNull(), cap("roe", 0.30)),
        F.when(_c("net_margin").isNotNull(), cap("net_margin", 0.20)),
        F.when(_c("roa").isNotNull(), cap("roa", 0.15)),
        F.when(_c("debt_equity").isNotNull(), normalize_range("debt_equity", 0, 2, invert=True))], 50.0)


def valuation_score() -> Column:
    multiple = lambda c, lo, hi: F.when(_c(c) > 0, normalize_range(c, lo, hi, invert=True))
    return mean_present([
        multiple("pe_ratio", 5, 40), multiple("ps_ratio", 0.5, 10), multiple("pb_ratio", 0.5, 5),
        F.when(_c("fcf_yield").isNotNull(), clamp(_c("fcf_yield") * 10, 0, 100))], 50.0)


def growth_score() -> Column:
    part = lambda c, full: F.when(_c(c).isNotNull(), clamp(_c(c) * 100 / full, 0, 100))
    return mean_present([part("revenue_growth", 0.30), part("earnings_growth", 0.40), part("fcf_growth", 0.30)], 50.0)


def technical_score() -> Column:
    rsi = F.when(_c("rsi_14") < 30, 70.0).when(_c("rsi_14") > 70, 40.0).when(_c("rsi_14").isNotNull(), 55.0)
    return mean_present([
        rsi, F.when(_c("momentum").isNotNull(), clamp(50 + _c("momentum"), 0, 100)),
        F.when(_c("drawdown").isNotNull(), normalize_range("drawdown", 0, 0.3, invert=True))], 50.0)


def sentiment_scores(news: DataFrame, links: DataFrame, since) -> DataFrame:
    """Mean sentiment of linked recent news on a 0..100 scale."""
    recent = news.filter(_c("published_at") >= since).select("news_id", "sentiment")
    return links.select("company_id", "news_id").join(recent, "news_id").groupBy("company_id").agg(
        ((F.avg("sentiment") + 1) * 50).alias("sentiment"))


def catalyst_scores(events: DataFrame, since) -> DataFrame:
    """50 plus 10 per positive, minus 10 per negative recent event."""
    sign = F.when(_c("impact") == "positive", 1).when(_c("impact") == "negative", -1).otherwise(0)
    return events.filter(_c("event_date") >= since).groupBy("company_id").agg(
        clamp(50 + F.sum(sign) * 10.0, 0, 100).alias("catalyst"))


def recommendation(score) -> Column:
    """First category whose threshold the score reaches."""
    out = None
    for level, name in SETTINGS.recommendation:
        hit = _c(score) >= level
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(SETTINGS.recommendation[-1][1])


def strong_categories() -> tuple[str, ...]:
    return tuple(n for level, n in SETTINGS.recommendation if level >= SETTINGS.strong_level)


def confidence_of(regime) -> Column:
    """Quality capped at 0.95 (0.5 on fallback or insufficient data), minus 0.05 in risk-off regimes."""
    fallback = F.coalesce(F.size("fallback_components") > 0, F.lit(True))
    ceiling = F.when(~_c("sufficient") | fallback, 0.5).otherwise(0.95)
    base = F.coalesce(F.bround(F.least(ceiling, _c("quality")), 4), F.lit(SETTINGS.base_confidence))
    return F.when(regime.isin("contraction_risk", "high_volatility"), clamp(base - 0.05, 0, 1)).otherwise(base)


def investment_scores(companies: DataFrame, metrics: DataFrame, technical: DataFrame, sentiment: DataFrame,
                      catalyst: DataFrame, risk: DataFrame, quality: DataFrame, regime: Column,
                      weights=SETTINGS.score) -> DataFrame:
    """Scores of every company; each input has at most one row per company."""
    rows = companies.select("company_id")
    for df in (metrics.drop("period"), technical.select("company_id", "rsi_14", "momentum", "drawdown"), sentiment,
               catalyst, risk.select("company_id", _c("risk_score").alias("risk"), "volatility"), quality.select(
                   "company_id", "quality", "sufficient", "fallback_components")):
        rows = rows.join(df, "company_id", "left")
    rows = rows.select(
        "company_id", "volatility", "quality", F.coalesce("sufficient", F.lit(False)).alias("sufficient"),
        "fallback_components",
        *[bounded_score(c).alias(n) for n, c in (
            ("fundamental", fundamental_score()), ("valuation", valuation_score()), ("growth", growth_score()),
            ("technical", technical_score()), ("sentiment", _c("sentiment")), ("catalyst", _c("catalyst")),
            ("risk", _c("risk")))])
    total = (_c("fundamental") * weights.fundamental + _c("valuation") * weights.valuation
             + _c("growth") * weights.growth + _c("technical") * weights.technical
             + _c("sentiment") * weights.sentiment + _c("catalyst") * weights.catalyst
             - _c("risk") * weights.risk)
    rows = rows.withColumn("overall", clamp(total, 0, 100)).withColumn("confidence", confidence_of(regime))
    rows = rows.withColumn("recommendation", recommendation("overall"))
    return rows.withColumn("issues", business_rules()).withColumn(
        "scoring_model", F.lit(SETTINGS.scoring_model)).withColumn("scoring_version", F.lit(SETTINGS.scoring_version))


def business_rules() -> Column:
    """Messages of the broken rules over the score columns."""
    checks = [F.when(~_c("overall").between(0, 100), "overall_score out of bounds [0, 100]")]
    checks += [F.when(~_c(n).between(0, 100), f"{n} score out of bounds [0, 100]") for n in COMPONENTS]
    checks += [
        F.when(~_c("confidence").between(0, 1), "confidence out of bounds [0, 1]"),
        F.when((_c("overall") >= 70) & (_c("confidence") < 0.5),
               "High overall score with low confidence without data quality warning"),
        F.when(~_c("sufficient") & _c("recommendation").isin(*strong_categories()),
               "strong recommendation issued with insufficient data quality"),
        F.when(_c("risk") > _c("overall") + 50, "Risk score is disproportionately high vs overall"),
    ]
    return F.array_compact(F.array(*checks))


def score_record(scores: DataFrame, companies: DataFrame) -> DataFrame:
    """Result record: ticker, score, components struct and provenance."""
    return scores.join(companies.select("company_id", "ticker"), "company_id").select(
        "ticker", _c("overall").alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "recommendation", F.struct(*COMPONENTS).alias("components"), "scoring_model", "scoring_version")


def product_scores(products: DataFrame) -> DataFrame:
    """Product score 40 % quality, 30 % demand, 30 % price competitiveness."""
    price = clamp(100 - F.coalesce("price", F.lit(100.0)) / 2, 0, 100)
    total = (F.coalesce("quality_score", F.lit(50.0)) * 0.4 + F.coalesce("demand_score", F.lit(50.0)) * 0.3
             + price * 0.3)
    return products.withColumn("_t", total).select(
        "product_id", F.bround("_t", 1).alias("score"), F.lit(0.7).alias("confidence"),
        F.when(_c("_t") >= 80, "STRONG_BUY").when(_c("_t") >= 60, "BUY").when(_c("_t") >= 40, "HOLD")
        .otherwise("AVOID").alias("recommendation"), F.bround(price, 1).alias("price_competitiveness"))
