"""Closed-form allocation of many portfolios at once, and portfolio measures.

Totals per portfolio and per (portfolio, sector) are windows over one exchange by
portfolio: the rows travel once and no plan reads them twice for a join. A portfolio
holds a ticker once, so its task is bounded by the list of tickers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.numeric import clamp
from tallyvane.operators.latest import top_per_key

# fixed values: risk aversion per profile
RISK_AVERSION = {"conservative": 3.0, "moderate": 1.5, "aggressive": 0.5}
# fixed values: diversification weights (holding distribution, sectors, holding count, correlation)
DIVERSIFICATION = {"holdings": 0.40, "sector": 0.30, "count": 0.20, "correlation": 0.10}
DROP_BELOW = 0.001


def target_weights(opportunities: DataFrame, keys: list[str]) -> DataFrame:
    """Weights from score and risk, capped per position, then scaled per sector.

    ``opportunities``: keys, ticker, seq, score, risk_score, sector, risk_profile,
    max_position_weight, max_sector_weight. The first row of a ticker counts.
    """
    rows = opportunities.withColumn("ticker", F.upper("ticker")).filter("ticker <> ''")
    # partitioned by the portfolio alone, like all that follows
    before = F.lag("ticker").over(Window.partitionBy(*keys).orderBy("ticker", "seq"))
    rows = rows.withColumn("_before", before).filter(~F.col("ticker").eqNullSafe(F.col("_before"))).drop("_before")
    aversion = F.create_map(*[F.lit(x) for pair in RISK_AVERSION.items() for x in pair])
    lam = F.coalesce(F.try_element_at(aversion, F.col("risk_profile")), F.lit(1.5))
    rows = rows.withColumn("_attr", F.greatest(F.lit(0.0), F.col("score") / (1 + lam * F.col("risk_score") / 100)))
    rows = rows.withColumn("_total", F.sum("_attr").over(Window.partitionBy(*keys))).withColumn("_w", F.least(
        F.when(F.col("_total") > 0, F.col("_attr") / F.col("_total")).otherwise(0.0), F.col("max_position_weight")))
    return cap_sectors(rows, keys, "_w").withColumnRenamed("_w", "weight").drop("_attr", "_total")


def cap_sectors(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Scale the weights of every sector that exceeds its limit down to it."""
    total = F.sum(weight).over(Window.partitionBy(*keys, "sector"))
    return rows.withColumn("_sector", total).withColumn(
        weight, F.col(weight) * F.when(F.col("_sector") > F.col("max_sector_weight"),
                                       F.col("max_sector_weight") / F.col("_sector")).otherwise(1.0)).drop("_sector")


def allocations(weighted: DataFrame) -> DataFrame:
    """Positions above the drop level with their amounts; the rest stays cash."""
    investable = F.col("capital") - F.col("cash_reserve")
    out = weighted.filter(F.col("weight") > DROP_BELOW).withColumn("amount", F.col("weight") * investable)
    return out.withColumn("portfolio_weight", F.coalesce(F.try_divide("amount", "capital"), F.lit(0.0)))


def portfolio_summary(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Cash split, weighted score, diagonal risk, diversification and the reason for unspent cash."""
    held = F.col("weight") > DROP_BELOW
    by_sector = weighted.groupBy(*keys, "sector").agg(
        F.first("capital").alias("capital"), F.first("cash_reserve").alias("cash_reserve"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(held, 1)).alias("n_held"),
        F.sum(F.when(held, F.col("weight")).otherwise(0.0)).alias("_held"),
        F.sum(F.col("weight") * F.col("score")).alias("weighted_score"),
        F.sum(F.col("weight") * F.col("weight") * F.col("volatility") * F.col("volatility")).alias("_var"), *_sector_sums())
    g = by_sector.groupBy(*keys).agg(
        F.first("capital").alias("capital"), F.first("cash_reserve").alias("cash_reserve"),
        *[F.sum(c).alias(c) for c in ("n", "n_held", "_held", "weighted_score")],
        F.sqrt(F.sum("_var")).alias("expected_risk"), _diversification().alias("diversification"))
    invest = F.col("capital") - F.col("cash_reserve")
    g = g.withColumn("allocated", F.col("_held") * invest).withColumn("unallocated", invest - F.col("allocated"))
    # float dust around zero is not unspent cash
    reason = (F.when(F.round("unallocated", 4) <= 0, "unknown")
              .when(F.col("n_held") == 0, "no qualifying investment opportunities")
              .when(F.col("n_held") < F.col("n"), "position/sector limits prevent full deployment")
              .otherwise("position limits prevent full deployment"))
    return g.withColumn("reason", reason).drop("_held")


def diversification(weighted: DataFrame, keys: list[str], correlation_known: bool = False) -> DataFrame:
    """0..100 from holding distribution, sector spread and holding count of the invested part."""
    g = weighted.groupBy(*keys, "sector").agg(*_sector_sums()).groupBy(*keys)
    return g.agg(_diversification(correlation_known).alias("diversification"))


def _sector_sums() -> list[Column]:
    """Invested weight of a sector, its sum of squares and its count."""
    weight = F.when(F.col("weight") > 0, F.col("weight"))
    return [F.sum(weight).alias("_s"), F.sum(F.pow(weight, F.lit(2.0))).alias("_s2"), F.count(weight).alias("_c")]


def _diversification(correlation_known: bool = False) -> Column:
    """The measure as an aggregate of sector sums; 0 where nothing is invested."""
    d = DIVERSIFICATION
    total = F.sum("_s") * F.sum("_s")
    raw = (d["holdings"] * (1 - F.sum("_s2") / total) + d["sector"] * (1 - F.sum(F.pow("_s", F.lit(2.0))) / total)
           + d["count"] * F.least(F.lit(1.0), F.sum("_c") / 10.0))
    score = raw + d["correlation"] * 0.5 if correlation_known else raw / (d["holdings"] + d["sector"] + d["count"])
    return F.when(F.sum("_c") > 0, F.round(clamp(score * 100, 0, 100), 2)).otherwise(0.0)


def correlated_risk(weights: DataFrame, returns: DataFrame, keys: list[str]) -> DataFrame:
    """sqrt(w' S w) with S = empirical correlation scaled by the given volatilities.

    Equal to the sample deviation of the weighted sum of standardised returns, so
    the work is linear in the rows and no pair of assets is ever formed.
    A constant series correlates with nothing and adds its own variance only.

    ``weights``: keys, asset, weight, volatility; ``returns``: asset, t, ret, on a
    common set of times per portfolio.
    """
    stats = returns.groupBy("asset").agg(F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"))
    w = weights.join(stats, "asset").withColumn("_wv", F.col("weight") * F.col("volatility"))
    flat = F.coalesce(F.col("_sd") == 0, F.lit(True))
    moving = w.filter(~flat).join(returns, "asset")
    series = moving.groupBy(*keys, "t").agg(
        F.sum(F.col("_wv") * (F.col("ret") - F.col("_mean")) / F.col("_sd")).alias("_r"))
    var = series.groupBy(*keys).agg(F.var_samp("_r").alias("_var"))
    own = w.groupBy(*keys).agg(F.sum(F.when(flat, F.pow("_wv", F.lit(2.0))).otherwise(0.0)).alias("_own"))
    return own.join(var, keys, "left").select(
        *keys, F.sqrt(F.coalesce("_var", F.lit(0.0)) + F.col("_own")).alias("risk"))


def _tenths(c) -> Column:
    """One decimal of the exact binary value, ties to even; ``format_string`` rounds its shortest decimal form half up."""
    return F.replace(F.format_number(c, 1), F.lit(","))


def explanations(weighted: DataFrame, summary: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Text lines of each portfolio with its largest positions, next to its diversification."""
    best = top_per_key(allocations(weighted), keys, [F.desc("weight"), F.asc("ticker")], top, rank_col="_rk")
    line = F.format_string("  %s: %s%% of investable (%s%% of total, $%,.0f)", "ticker",
                           _tenths(F.col("weight") * 100), _tenths(F.col("portfolio_weight") * 100), "amount")
    lines = best.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rk", line.alias("line")))), lambda s: s["line"]), "\n").alias("_lines"))
    s = summary.join(lines, keys, "left")
    text = F.concat_ws(
        "\n",
        F.format_string("Capital: $%,.0f (Cash reserve: $%,.0f).", "capital", "cash_reserve"),
        F.format_string("Allocated capital: $%,.0f.", "allocated"),
        F.format_string("Unallocated capital: $%,.0f.", F.round("unallocated", 4) + 0.0),  # no minus before zero
        F.format_string("Portfolio expected risk: %s%%", _tenths(F.col("expected_risk") * 100)),
        F.format_string("Diversification score: %.0f/100", "diversification"),
        F.format_string("Portfolio fit score: %s/100", _tenths("weighted_score")),
        F.lit("Top allocations:"), F.coalesce("_lines", F.lit("")))
    return s.select(*keys, "diversification", text.alias("explanation"))


def latest_opportunities(scores: DataFrame, risk: DataFrame, companies: DataFrame, limit: int | None = 20) -> DataFrame:
    """Latest score per company with risk defaults 50 / 0.25 / Unknown, best first."""
    from tallyvane.operators.latest import latest_per_key

    rows = (latest_per_key(scores, ["company_id"], "ts").select("company_id", "overall_score")
            .join(companies.select("company_id", "ticker", "sector"), "company_id")
            .join(risk.select("company_id", "risk_score", "volatility"), "company_id", "left"))
    rows = rows.select(
        "company_id", "ticker", F.coalesce("overall_score", F.lit(50.0)).alias("score"),
        F.coalesce("risk_score", F.lit(50.0)).alias("risk_score"),
        F.coalesce("volatility", F.lit(0.25)).alias("volatility"), F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return rows if limit is None else rows.orderBy(F.desc("score"), "company_id").limit(limit)
