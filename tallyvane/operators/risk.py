"""Risk metrics per company over a bar window (calendar-bounded groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.numeric import clamp, mean_present, safe_corr, safe_divide
from tallyvane.operators.indicators import TRADING_DAYS, ordered_bars

METRICS = ("risk_score", "volatility", "beta", "max_drawdown", "value_at_risk", "liquidity_score",
           "fundamental_risk", "event_risk", "concentration_risk", "sector_risk", "correlation_risk",
           "confidence")


def price_risk(bars: DataFrame, min_bars: int = 20) -> DataFrame:
    """Volatility, drawdown, VaR, liquidity and autocorrelation from returns."""
    w = Window.partitionBy("company_id").orderBy("ts")
    rows = ordered_bars(bars).withColumn("prev_ret", F.lag("ret").over(w))
    n_ret = F.count("ret")
    avg_vol = F.avg(F.when(F.col("age") <= 20, F.col("volume")))
    ac = safe_corr("ret", "prev_ret")
    return rows.groupBy("company_id").agg(
        F.max("ts").alias("ts"),
        F.max("n").alias("n_bars"),
        F.when(n_ret >= 20, F.stddev_samp("ret") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("volatility"),
        F.abs(F.min(F.try_divide(F.col("px") - F.col("peak"), F.col("peak")))).alias("max_drawdown"),
        F.when(n_ret >= 30, F.percentile("ret", F.lit(0.05))).alias("value_at_risk"),
        F.when(F.max("n") >= 20, F.when(avg_vol <= 0, 0.0).otherwise(clamp(F.log10(avg_vol) / 7, 0, 1)))
        .alias("liquidity_score"),
        F.when(n_ret >= 30, ac).alias("autocorr"),
    ).filter(F.col("n_bars") >= min_bars)


def statement_risk(latest: DataFrame) -> DataFrame:
    """Step functions over the newest statement (leverage, losses, cash burn)."""
    de = F.when((F.col("total_debt") != 0) & (F.col("shareholders_equity") != 0),
                safe_divide("total_debt", "shareholders_equity"))
    fundamental = (F.lit(0.5) + F.when(de > 2, 0.2).when(de > 1, 0.1).otherwise(0.0)
                   + F.when(F.col("net_income") < 0, 0.15).otherwise(0.0)
                   + F.when(F.col("free_cash_flow") < 0, 0.1).otherwise(0.0))
    sector = F.lit(0.3) + F.when(F.col("total_debt") > 0,
                                 F.when(de > 2, 0.3).when(de > 1, 0.15).otherwise(0.0)).otherwise(0.0)
    return latest.select("company_id", F.least(F.lit(1.0), fundamental).alias("fundamental_risk"),
                         F.least(F.lit(1.0), sector).alias("sector_risk"))


def event_risk(events: DataFrame, since) -> DataFrame:
    """0.1 plus 0.15 per negative event since the given time, at most 1."""
    recent = events.filter(F.col("event_date") >= since)
    negatives = recent.groupBy("company_id").agg(
        F.sum(F.when(F.col("impact") == "negative", 1).otherwise(0)).alias("n"))
    return negatives.select("company_id", F.least(F.lit(1.0), 0.1 + F.col("n") * 0.15).alias("event_risk"))


def risk_metrics(bars: DataFrame, latest: DataFrame, events: DataFrame, events_since) -> DataFrame:
    """All risk columns; the score averages the components that exist."""
    out = (
        price_risk(bars)
        .join(statement_risk(latest), "company_id", "left")
        .join(event_risk(events, events_since), "company_id", "left")
        .withColumn("event_risk", F.coalesce("event_risk", F.lit(0.1)))
    )
    parts = [F.col(c) for c in ("volatility", "max_drawdown", "fundamental_risk", "event_risk")]
    return out.select(
        "company_id", "ts", "n_bars",
        clamp(mean_present(parts, 0.5) * 100, 0, 100).alias("risk_score"),
        "volatility",
        clamp(1 + F.col("autocorr"), 0.1, 2.0).alias("_beta_raw"),
        "autocorr", "max_drawdown", "value_at_risk", "liquidity_score", "fundamental_risk", "event_risk",
        F.when(F.col("volatility").isNotNull(), clamp(F.col("volatility") / 0.60, 0, 1)).alias("concentration_risk"),
        "sector_risk",
        F.when(F.col("autocorr").isNotNull(), F.least(F.lit(1.0), F.abs("autocorr") / 0.3)).alias("correlation_risk"),
        F.least(F.lit(1.0), F.col("n_bars") / 252).alias("confidence"),
    ).withColumn("beta", F.when(F.col("autocorr").isNotNull(), F.col("_beta_raw"))).drop("_beta_raw", "autocorr")


def market_beta(returns: DataFrame, market: DataFrame, min_obs: int = 30) -> DataFrame:
    """cov / var against a market return series on common dates."""
    both = returns.join(market.select("ts", F.col("ret").alias("market_ret")), "ts").filter(
        F.col("ret").isNotNull() & F.col("market_ret").isNotNull())
    return both.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp("ret", "market_ret").alias("cov"), F.var_samp("market_ret").alias("var"),
    ).select("company_id", "n", F.when((F.col("n") >= min_obs) & (F.col("var") > 0),
                                       F.col("cov") / F.col("var")).alias("beta"))
