"""Composite jobs over all companies; each returns the tables it would store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.operators import events, fundamentals, indicators, linking, statements, upsert, validation
from tallyvane.operators.materialize import stored
from tallyvane.sources import vendor
from tallyvane.sources.store import Store


def process_news(raw_items: DataFrame, stored: DataFrame, companies: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Raw items -> valid, new, enriched articles and their company links.

    ``raw_items``: news_id, source, external_id, title, summary, url, published_at,
    sentiment, tickers, content_hash.
    """
    valid = validation.accepted(validation.check(raw_items, validation.news_rules()))
    fresh = upsert.new_news(valid, stored, "news_id")
    return events.enrich_news(fresh, as_of), linking.link_news(fresh.select("news_id", "title", "tickers"), companies)


def ingest_fundamentals(primary: DataFrame, income: DataFrame, balance: DataFrame, cashflow: DataFrame,
                        stored: DataFrame) -> DataFrame:
    """Statements to add: filings where a company has any, else the merged vendor families.

    ``primary``: filing payloads; the others: vendor family payloads.
    """
    official = vendor.filing_statements(primary)
    parts = {f: vendor.statement_family(p, f) for f, p in (("income", income), ("balance", balance), ("cashflow", cashflow))}
    merged = statements.merge_families(parts["income"], parts["balance"], parts["cashflow"])
    rows = official.withColumn("origin", F.lit("filing")).unionByName(
        merged.withColumn("origin", F.lit("vendor")), allowMissingColumns=True)
    # both sides are read once: a company's filings turn its vendor rows away where they meet
    filed = F.max(F.col("origin") == "filing").over(Window.partitionBy("company_id"))
    rows = rows.withColumn("_filed", filed).filter("origin = 'filing' OR NOT _filed OR company_id IS NULL").drop("_filed")
    good = validation.accepted(validation.check(rows, validation.statement_rules())).withColumn("seq", F.lit(0))
    return upsert.new_rows(good, stored, ["company_id", "period", "period_type"], "seq").drop("seq")


def first_load(bars: DataFrame, statement_rows: DataFrame, company_id: int) -> tuple[DataFrame, DataFrame]:
    """Derived tables of a single company: the same plans behind one key filter."""
    one = F.col("company_id") == company_id
    return (indicators.technical_indicators(bars.filter(one)), fundamentals.financial_metrics(statement_rows.filter(one)))


FUNDAMENTALS = {
    "statements": ("company_id bigint, period string, period_type string, origin string, revenue double, net_income double, total_assets double, "
                   "shareholders_equity double"),
    "profiles": "company_id bigint, name string, sector string, industry string",
}


def store_fundamentals(store: Store, primary: DataFrame, income: DataFrame, balance: DataFrame, cashflow: DataFrame, companies: DataFrame,
                       profiles: DataFrame) -> dict[str, int]:
    """Append new statements and the company rows that a profile changes, in one commit; a second pass adds nothing.

    ``companies``: the known rows, overlaid by those stored before; ``profiles``: company_id, name, sector, industry, where a non-empty value wins.
    """
    have = store.read("statements").select("company_id", "period", "period_type")
    rows = ingest_fundamentals(primary, income, balance, cashflow, have)
    facts = ("revenue", "net_income", "total_assets", "shareholders_equity")
    rows = stored(rows.select("company_id", "period", "period_type", "origin", *[F.col(c).cast("double").alias(c) for c in facts]), "new-statements")
    names = ["name", "sector", "industry"]
    past = store.latest("profiles", ["company_id"]).select("company_id", *names)
    known = companies.select("company_id", *names).join(past, "company_id", "left_anti").unionByName(past)
    merged = upsert.overlay_profile(known, profiles, "company_id", names)
    before = known.select("company_id", F.struct(*names).alias("_old"))
    changed = stored(merged.join(before, "company_id").filter(~F.struct(*names).eqNullSafe(F.col("_old"))).drop("_old"), "changed-profiles")
    if rows.isEmpty() and changed.isEmpty():
        return {}
    return store.commit(store.next_name("fundamentals"), "fundamentals", lambda: {"statements": rows, "profiles": changed})
