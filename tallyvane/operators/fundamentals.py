"""Ratios, growth, coverage and statement lists per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.numeric import growth_rate, safe_divide
from tallyvane.operators.latest import latest_per_key, top_per_key

RATIOS = ("gross_margin", "operating_margin", "net_margin", "roe", "roa", "debt_equity", "fcf_yield",
          "revenue_growth", "earnings_growth", "fcf_growth")
# fixed values: the inputs of each financial component
COMPONENT_FIELDS = {
    "fundamental": ("roe", "net_margin", "roa", "debt_equity"),
    "valuation": ("pe_ratio", "ps_ratio", "pb_ratio", "fcf_yield"),
    "growth": ("revenue_growth", "earnings_growth", "fcf_growth"),
}


def recent_statements(statements: DataFrame, limit: int = 8) -> DataFrame:
    """Newest ``limit`` quarterly statements of each company."""
    quarterly = statements.filter(F.col("period_type") == "quarterly")
    return top_per_key(quarterly, ["company_id"], [F.desc("period")], limit, rank_col="age")


def financial_metrics(statements: DataFrame) -> DataFrame:
    """Latest quarter's margins, returns and leverage, growth against four quarters before.

    Price multiples stay NULL: the metrics job has no market data.
    """
    rows = recent_statements(statements)
    w = Window.partitionBy("company_id").orderBy("period")
    year_ago = lambda c: F.lag(c, 4).over(w)
    rows = rows.select(
        "company_id", "period", "age",
        safe_divide("gross_profit", "revenue").alias("gross_margin"),
        safe_divide("operating_income", "revenue").alias("operating_margin"),
        safe_divide("net_income", "revenue").alias("net_margin"),
        safe_divide("net_income", "shareholders_equity").alias("roe"),
        safe_divide("net_income", "total_assets").alias("roa"),
        safe_divide("total_debt", "shareholders_equity").alias("debt_equity"),
        safe_divide("free_cash_flow", "revenue").alias("fcf_yield"),
        growth_rate("revenue", year_ago("revenue")).alias("revenue_growth"),
        growth_rate("net_income", year_ago("net_income")).alias("earnings_growth"),
        growth_rate("free_cash_flow", year_ago("free_cash_flow")).alias("fcf_growth"),
    ).filter("age = 1").drop("age")
    return rows.withColumns({c: F.lit(None).cast("double") for c in ("pe_ratio", "ps_ratio", "pb_ratio", "ev_ebitda")})


def latest_statement(statements: DataFrame) -> DataFrame:
    """Newest statement of any type; quarterly before annual on the same period."""
    return latest_per_key(statements, ["company_id"], "period", "period_type")


def usable(field: str) -> Column:
    """Finite number; price multiples must also be positive."""
    c = F.col(field)
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok & (c > 0) if field in ("pe_ratio", "ps_ratio", "pb_ratio") else ok


def financial_completeness(joined: DataFrame, as_of) -> DataFrame:
    """Coverage, missing inputs, fallback components and reporting freshness.

    ``joined``: metrics columns plus ``reporting_period`` and ``metrics_ts``.
    Any three of the four valuation inputs count as full coverage.
    """
    out = joined
    for name, fields in COMPONENT_FIELDS.items():
        need = 3 if name == "valuation" else len(fields)
        hits = sum((usable(f).cast("int") for f in fields), F.lit(0))
        out = out.withColumn(f"coverage_{name}", F.least(F.lit(1.0), hits / need))
        out = out.withColumn(f"missing_{name}", F.array_compact(
            F.array(*[F.when(~F.coalesce(usable(f), F.lit(False)), F.lit(f)) for f in fields])))
    age = F.datediff(as_of, F.to_date("reporting_period"))
    fresh = (F.when(age.between(0, 150), 1.0).when((age > 150) & (age <= 400), 0.5).otherwise(0.0))
    mean = (F.col("coverage_fundamental") + F.col("coverage_valuation") + F.col("coverage_growth")) / 3
    stale = F.col("metrics_ts") < F.timestamp_seconds(F.unix_timestamp(as_of) - 90 * 86400)
    quality = F.when(F.col("metrics_ts").isNull(), 0.0).otherwise(
        mean * F.col("reporting_freshness") * F.when(stale, 0.5).otherwise(1.0))
    return (
        out.withColumn("reporting_freshness", fresh)
        .withColumn("fallback_components", F.array_compact(F.array(*[
            F.when(F.col(f"coverage_{n}") == 0, F.lit(n)) for n in COMPONENT_FIELDS])))
        .withColumn("financial_quality", quality)
    )
