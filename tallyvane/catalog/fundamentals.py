"""Queries over statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd, sql_rnd
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import fundamentals as fund

add_view("quarters", "statements", """
    SELECT *, lag(revenue, 4) OVER w AS rev4, lag(net_income, 4) OVER w AS ni4, lag(free_cash_flow, 4) OVER w AS fcf4,
           row_number() OVER (PARTITION BY company_id ORDER BY period DESC) AS age
    FROM statements WHERE period_type = 'quarterly'
    WINDOW w AS (PARTITION BY company_id ORDER BY period)""")
add_view("metrics", "quarters", """
    SELECT company_id, period, gross_profit / nullif(revenue, 0) AS gross_margin,
           operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin,
           net_income / nullif(shareholders_equity, 0) AS roe, net_income / nullif(total_assets, 0) AS roa,
           total_debt / nullif(shareholders_equity, 0) AS debt_equity, free_cash_flow / nullif(revenue, 0) AS fcf_yield,
           (revenue - rev4) / nullif(abs(rev4), 0) AS revenue_growth,
           (net_income - ni4) / nullif(abs(ni4), 0) AS earnings_growth,
           (free_cash_flow - fcf4) / nullif(abs(fcf4), 0) AS fcf_growth
    FROM quarters WHERE age = 1""")
add_view("last_statement", "statements", """
    SELECT * FROM statements
    QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period DESC, period_type DESC) = 1""")


@query("financial_metrics", "G15 N8", with_views("metrics", f"""
    SELECT company_id, period, {sql_rnd(*fund.RATIOS)}, NULL::DOUBLE AS pe_ratio FROM metrics"""))
def financial_metrics(m):
    return fund.financial_metrics(m.statements()).select("company_id", "period", *rnd(*fund.RATIOS), "pe_ratio")


@query("recent_statements", "A7 H18", with_views("quarters", """
    SELECT company_id, period, age, revenue, net_income FROM quarters WHERE age <= 8"""))
def recent_statements(m):
    return fund.recent_statements(m.statements(), 8).select(
        "company_id", "period", F.col("age").cast("long").alias("age"), "revenue", "net_income")


@query("latest_statement", "H18", with_views("last_statement", """
    SELECT company_id, period, period_type, revenue, total_debt FROM last_statement"""))
def latest_statement(m):
    return fund.latest_statement(m.statements()).select(
        "company_id", "period", "period_type", "revenue", "total_debt")
