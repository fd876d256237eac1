"""Queries over allocations: every customer is a portfolio of the suppliers it bought from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd, sql_rnd
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import portfolio as p
from tallyvane.operators.latest import latest_per_key

add_view("opps", "scores companies", """
    SELECT o.*, s.overall_score AS score, s.risk_score, 0.15 + company_id % 11 * 0.03 AS volatility, ticker, sector FROM (
      SELECT DISTINCT c_custkey AS portfolio_id, l_suppkey AS company_id, 20000 + c_custkey % 7 * 15000 AS capital,
             1000 AS cash_reserve, (['conservative', 'moderate', 'aggressive'])[c_custkey % 3 + 1] AS profile,
             CASE c_custkey % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.5 ELSE 0.5 END AS lam
      FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey) o
    JOIN (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ts DESC) = 1) s USING (company_id)
    JOIN companies USING (company_id)""")
add_view("weights", "opps", """
    SELECT *, w1 * CASE WHEN sum(w1) OVER (PARTITION BY portfolio_id, sector) > 0.3
                        THEN 0.3 / sum(w1) OVER (PARTITION BY portfolio_id, sector) ELSE 1 END AS weight FROM (
      SELECT *, least(0.15, CASE WHEN sum(a) OVER p > 0 THEN a / sum(a) OVER p ELSE 0 END)::DOUBLE AS w1 FROM (
        SELECT *, greatest(0, score / (1 + lam * risk_score / 100))::DOUBLE AS a FROM opps)
      WINDOW p AS (PARTITION BY portfolio_id))""")
add_view("divers", "weights", """
    SELECT portfolio_id, round(100 * (0.4 * (1 - w2 / (w * w)) + 0.3 * (1 - s2 / (w * w)) + 0.2 * least(1, c / 10)) / 0.9, 2) AS diversification
    FROM (SELECT portfolio_id, sum(w) AS w, sum(w2) AS w2, sum(w * w) AS s2, sum(c) AS c FROM (
      SELECT portfolio_id, sector, sum(weight) AS w, sum(weight * weight) AS w2, count(*) AS c FROM weights WHERE weight > 0 GROUP BY ALL)
      GROUP BY 1)""")
add_view("book", "weights divers", """
    SELECT *, inv * held AS allocated, inv - inv * held AS unallocated FROM (
      SELECT portfolio_id, any_value(capital) AS capital, any_value(capital - cash_reserve)::DOUBLE AS inv, count(*) AS n,
             count(*) FILTER (weight > 0.001) AS n_held, coalesce(sum(weight) FILTER (weight > 0.001), 0) AS held,
             sum(weight * score) AS weighted_score, sqrt(sum(weight * weight * volatility * volatility)) AS expected_risk
      FROM weights GROUP BY 1) LEFT JOIN divers USING (portfolio_id)""")


def opportunities(m):
    orders = m.table("orders").select("o_orderkey", "o_custkey").join(
        m.table("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    pairs = (orders.join(m.table("lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
             .select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("company_id")).distinct())
    latest = latest_per_key(m.scores(), ["company_id"], "ts").select(
        "company_id", F.col("overall_score").alias("score"), "risk_score")
    facts = latest.join(m.companies().select("company_id", "ticker", "sector"), "company_id")
    # narrow rows travel to their portfolio once; what follows from its key is computed there
    held = pairs.join(facts, "company_id").repartition("c_custkey")
    profiles = F.array(*[F.lit(x) for x in ("conservative", "moderate", "aggressive")])
    return held.select(
        F.col("c_custkey").alias("portfolio_id"), "ticker", F.col("company_id").alias("seq"), "score", "risk_score", "sector",
        ((15 + F.col("company_id") % 11 * 3) / 100.0).alias("volatility"),  # hundredths without float dust
        (20000.0 + F.col("c_custkey") % 7 * 15000).alias("capital"), F.lit(1000.0).alias("cash_reserve"),
        F.element_at(profiles, (F.col("c_custkey") % 3 + 1).cast("int")).alias("risk_profile"),
        F.lit(0.15).alias("max_position_weight"), F.lit(0.30).alias("max_sector_weight"))


def weighted(m):
    return p.target_weights(opportunities(m), ["portfolio_id"])


@query("portfolio_allocations", "K9 K10 H6", with_views("weights", """
    SELECT portfolio_id, ticker, round(weight, 6) AS weight, round(weight * (capital - cash_reserve), 4) AS amount,
           round(weight * (capital - cash_reserve) / capital, 6) AS portfolio_weight FROM weights WHERE weight > 0.001"""))
def portfolio_allocations(m):
    return p.allocations(weighted(m)).select("portfolio_id", "ticker", *rnd("weight"), *rnd("amount", digits=4),
                                             *rnd("portfolio_weight"))


@query("portfolio_summaries", "K9 F20 F21", with_views("book", """
    SELECT portfolio_id, n, n_held, round(allocated, 4) AS allocated, round(unallocated, 4) AS unallocated,
           round(weighted_score, 6) AS weighted_score, round(expected_risk, 6) AS expected_risk, round(diversification, 1) AS diversification,
           CASE WHEN round(unallocated, 4) <= 0 THEN 'unknown' WHEN n_held = 0 THEN 'no qualifying investment opportunities'
                WHEN n_held < n THEN 'position/sector limits prevent full deployment'
                ELSE 'position limits prevent full deployment' END AS reason
    FROM book"""))
def portfolio_summaries(m):
    """Every portfolio's totals and why cash is left; one without any weight has no diversification."""
    s = p.portfolio_summary(weighted(m), ["portfolio_id"]).withColumn("diversification", F.nullif("diversification", F.lit(0.0)))
    return s.select("portfolio_id", "n", "n_held", *rnd("allocated", "unallocated", digits=4),
                    *rnd("weighted_score", "expected_risk"), *rnd("diversification", digits=1), "reason")


@query("portfolio_explanations", "K11", with_views("book", """
    SELECT portfolio_id, 'Capital: $' || format('{:,}', capital) || ' (Cash reserve: $1,000).' AS head,
           'Diversification score: ' AS part, 8::BIGINT + n_lines AS lines
    FROM book JOIN (SELECT portfolio_id, least(5, count(*) FILTER (weight > 0.001)) - (count(*) FILTER (weight > 0.001) > 0)::INT AS n_lines FROM weights GROUP BY 1) USING (portfolio_id)"""))
def portfolio_explanations(m):
    w = weighted(m)
    e = p.explanations(w, p.portfolio_summary(w, ["portfolio_id"]), ["portfolio_id"])
    lines = F.split("explanation", "\n")
    return e.select("portfolio_id", F.element_at(lines, 1).alias("head"),
                    F.regexp_extract("explanation", "(Diversification score: )", 1).alias("part"),
                    F.size(lines).cast("long").alias("lines"))


add_view("monthly", "bars companies", """
    SELECT company_id, sector, date_trunc('month', ts) AS t, arg_max(close, ts) AS c
    FROM bars JOIN companies USING (company_id) GROUP BY ALL""")
add_view("month_rets", "monthly", """
    SELECT *, c / lag(c) OVER (PARTITION BY company_id ORDER BY t) - 1 AS ret FROM monthly""")
add_view("sector_size", "monthly", "SELECT sector, count(DISTINCT company_id) AS n FROM monthly GROUP BY 1")
add_view("common_months", "month_rets sector_size", """
    SELECT sector, t FROM month_rets JOIN sector_size USING (sector) WHERE ret IS NOT NULL
    GROUP BY sector, t, n HAVING count(*) = n""")
add_view("aligned", "month_rets common_months sector_size", """
    SELECT r.*, n, 0.15 + company_id % 11 * 0.03 AS v
    FROM month_rets r JOIN common_months USING (sector, t) JOIN sector_size USING (sector)""")


@query("portfolio_correlated_risk", "F21", with_views("aligned", """
    SELECT sector, round(sqrt(sum(term)), 6) AS risk FROM (
      SELECT a.sector, any_value(a.v * b.v) / (any_value(a.n) * any_value(a.n))
             * CASE WHEN a.company_id = b.company_id THEN 1 ELSE corr(a.ret, b.ret) END AS term
      FROM aligned a JOIN aligned b ON a.sector = b.sector AND a.t = b.t
      GROUP BY a.sector, a.company_id, b.company_id) GROUP BY sector"""))
def portfolio_correlated_risk(m):
    """Equal-weight sector portfolios over months in which every member has a return."""
    bars = m.bars().join(m.companies().select("company_id", "sector"), "company_id")
    monthly = bars.groupBy("company_id", "sector", F.date_trunc("month", "ts").alias("t")).agg(
        F.max_by("close", "ts").alias("c"))
    w = Window.partitionBy("company_id").orderBy("t")
    rets = monthly.withColumn("ret", F.col("c") / F.lag("c").over(w) - 1)
    size = rets.groupBy("sector").agg(F.countDistinct("company_id").alias("n"))
    rets = rets.filter("ret IS NOT NULL")
    common = rets.groupBy("sector", "t").agg(F.count(F.lit(1)).alias("k")).join(size, "sector").filter("k = n").select("sector", "t")
    rets = rets.join(common, ["sector", "t"]).withColumnRenamed("company_id", "asset")
    weights = rets.select("sector", "asset").distinct().join(size, "sector").select(
        "sector", "asset", (1 / F.col("n")).alias("weight"), (0.15 + F.col("asset") % 11 * 0.03).alias("volatility"))
    return p.correlated_risk(weights, rets.select("asset", "t", "ret"), ["sector"]).select("sector", *rnd("risk"))


@query("latest_opportunities", "H4 E5", with_views("scores companies", """
    SELECT ticker, score, risk_score, volatility, sector FROM (
      SELECT 'S' || company_id AS ticker, company_id, overall_score AS score,
             CASE WHEN company_id % 5 = 0 THEN 50.0 ELSE risk_score END::DOUBLE AS risk_score,
             CASE WHEN company_id % 5 = 0 THEN 0.25 ELSE 0.3 END::DOUBLE AS volatility, sector
      FROM scores JOIN companies USING (company_id)
      QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ts DESC) = 1)
    ORDER BY score DESC, company_id LIMIT 20"""))
def latest_opportunities(m):
    """Every fifth company has no risk row, so its defaults apply."""
    risk = latest_per_key(m.scores(), ["company_id"], "ts").filter(F.col("company_id") % 5 != 0).select(
        "company_id", "risk_score", F.lit(0.3).alias("volatility"))
    return p.latest_opportunities(m.scores(), risk, m.companies()).select(
        "ticker", "score", "risk_score", "volatility", "sector")
