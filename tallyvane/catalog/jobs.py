"""Composite jobs, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd, sql_rnd
from tallyvane.catalog.ingest import family_payloads, filing_payloads, hashed_news
from tallyvane.catalog.prices import TECH_DAYS
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import with_views
from tallyvane.plans import jobs


class _Half:
    """Market whose filings cover even companies only."""

    def __init__(self, m):
        self.m = m

    def statements(self):
        return self.m.statements().filter(F.col("company_id") % 2 == 0)


@query("fundamentals_job", "D8 B3", with_views("statements", """
    SELECT company_id, origin, count(*) AS n FROM (
      SELECT company_id, period, period_type, CASE WHEN company_id % 2 = 0 THEN 'filing' ELSE 'vendor' END AS origin FROM statements
      WHERE company_id % 2 = 0 OR period_type = 'quarterly') WHERE period >= '1999' GROUP BY ALL"""))
def fundamentals_job(m):
    """Filings for even companies, vendor statements for the rest; periods before 1999 are stored."""
    stored = m.statements().filter("period < '1999'")
    out = jobs.ingest_fundamentals(filing_payloads(_Half(m)), *[family_payloads(m, f) for f in ("income", "balance", "cashflow")], stored)
    return out.groupBy("company_id", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("news_job", "B19 B5 J5 E16", with_views("news", """
    SELECT news_id, news_id % n AS company_id, method FROM (
      SELECT news_id, (SELECT n_companies FROM facts) AS n, CASE WHEN news_id % 2 = 0 THEN 'ticker' ELSE 'name_match' END AS method
      FROM news WHERE news_id % 10 <> 1 AND news_id % 9 <> 0)"""))
def news_job(m):
    """A tenth of the articles is stored, every ninth has an impossible sentiment."""
    tickers = F.when(F.col("related").isNotNull(), F.array("related")).otherwise(F.array().cast("array<string>"))
    raw = hashed_news(m).withColumn("tickers", tickers).withColumn(
        "sentiment", F.when(F.col("news_id") % 9 == 0, 2.0).otherwise(F.col("sentiment"))).withColumn(
        "content_hash", F.sha2(F.col("news_id").cast("string"), 256)).withColumn("external_id", F.lit(None).cast("string"))
    stored = raw.filter(F.col("news_id") % 10 == 1)
    enriched, links = jobs.process_news(raw, stored, m.companies(), m.now)
    return links.join(enriched.select("news_id"), "news_id").select("news_id", "company_id", "method")


@query("first_load_of_one_company", "N11", with_views("technical metrics", f"""
    SELECT company_id, round(sma_20, 6) AS sma_20, {sql_rnd("net_margin", "roe")} FROM technical JOIN metrics USING (company_id) WHERE company_id = 7"""))
def first_load_of_one_company(m):
    """The feature is one key; the filter reaches both scans."""
    tech, metrics = jobs.first_load(m.recent_bars(TECH_DAYS), m.statements(), 7)
    return tech.join(metrics, "company_id").select("company_id", *rnd("sma_20", "net_margin", "roe"))
