"""Queries over vendor payloads, upserts and identifiers.

Payload text is derived by Spark from the bars, statements, macro and news
views, then parsed back through the vendor parsers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import day_text, rnd, sql_day, sql_rnd, time_text, sql_time
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.functions import ids
from tallyvane.operators import linking, statements, upsert, validation
from tallyvane.sources import vendor

_BAR_COLS = ["open", "high", "low", "close", "adjusted_close", "volume"]


def _payload(df, keys, struct_col, wrap=None, order="desc"):
    """One JSON payload per key from the sorted list of its rows."""
    items = F.sort_array(F.collect_list(struct_col), asc=order == "asc")
    body = F.struct(items.alias(wrap)) if wrap else items
    return df.groupBy(*keys).agg(F.to_json(body).alias("payload"))


def _text(c):
    return F.col(c).cast("string").alias(c)


@query("vendor_paged_bars", "A10 C4", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, open, high, low,
           CASE WHEN day(ts) = 15 THEN close + 1 ELSE close END AS close,
           CASE WHEN day(ts) = 15 THEN close + 1 ELSE close END AS adjusted_close, volume
    FROM bars"""))
def vendor_paged_bars(m):
    """Newest-first string bars; page 2 restates every bar of a 15th."""
    bars = m.bars().withColumn("datetime", F.date_format("ts", "yyyy-MM-dd"))
    second = bars.filter(F.dayofmonth("ts") == 15).withColumn("close", F.col("close") + 1)
    pages = bars.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2)))
    item = F.struct("datetime", *[_text(c) for c in ("open", "high", "low", "close", "volume")])
    rows = vendor.paged_bars(_payload(pages, ["company_id", "page"], item, "values"))
    return rows.select("company_id", day_text("ts"), *_BAR_COLS)


@query("vendor_column_bars", "A11", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, open, high, low, close, close AS adjusted_close, volume
    FROM bars WHERE company_id % 10 <> 0"""))
def vendor_column_bars(m):
    item = F.struct("ts", "open", "high", "low", "close", "volume")
    rows = m.bars().groupBy("company_id").agg(F.sort_array(F.collect_list(item)).alias("b"))
    pick = lambda f: F.transform("b", f)
    payload = F.to_json(F.struct(
        F.when(F.col("company_id") % 10 == 0, "no_data").otherwise("ok").alias("s"),
        pick(lambda x: F.unix_timestamp(x["ts"])).alias("t"),
        pick(lambda x: x["open"]).alias("o"), pick(lambda x: x["high"]).alias("h"),
        pick(lambda x: x["low"]).alias("l"), pick(lambda x: x["close"]).alias("c"),
        pick(lambda x: x["volume"]).alias("v")))
    out = vendor.column_bars(rows.select("company_id", payload.alias("payload")))
    return out.select("company_id", day_text("ts"), *_BAR_COLS)


@query("vendor_dated_bars", "A12", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, open, high, low, close,
           CASE WHEN month(ts) = 2 THEN close ELSE adjusted_close END AS adjusted_close, volume FROM bars"""))
def vendor_dated_bars(m):
    bars = m.bars().withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    item = F.struct("date", "open", "high", "low", "close",
                    F.when(F.month("ts") != 2, F.col("adjusted_close")).alias("adjClose"), "volume")
    rows = vendor.dated_bars(_payload(bars, ["company_id"], item, "historical"))
    return rows.select("company_id", day_text("ts"), *_BAR_COLS)


# millisecond stamps are recognised above 1e12 (after 2001-09), so the payload is shifted by 20 years
_SHIFT = 7305 * 86400


@query("vendor_short_key_bars", "A12", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, open, high, low, close, close AS adjusted_close, volume FROM bars"""))
def vendor_short_key_bars(m):
    item = F.struct(((F.unix_timestamp("ts") + _SHIFT) * 1000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
                    F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    rows = vendor.short_key_bars(_payload(m.bars(), ["company_id"], item, "results"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") - _SHIFT))
    return rows.select("company_id", day_text("ts"), *_BAR_COLS)


def feed_payloads(m):
    related = F.concat(F.coalesce("related", F.lit("")), F.lit(" , ,S1,"))
    return m.news().select(F.to_json(F.struct(
        F.col("news_id").cast("string").alias("id"), F.col("title").alias("headline"), "url",
        F.unix_timestamp("published_at").cast("string").alias("datetime"), "summary",
        related.alias("related"), "sentiment")).alias("payload"))


@query("vendor_feed_news", "A13 C4 C7", with_views("news", f"""
    SELECT CAST(news_id AS VARCHAR) AS external_id, title, {sql_time("published_at")},
           length(summary) AS summary_chars, coalesce(related || ',', '') || 'S1' AS tickers, sentiment
    FROM news"""))
def vendor_feed_news(m):
    return vendor.feed_news(feed_payloads(m)).select(
        "external_id", "title", time_text("published_at"),
        F.length("summary").cast("long").alias("summary_chars"),
        F.array_join("tickers", ",").alias("tickers"), "sentiment")


@query("vendor_catalogue_news", "A13", with_views("news", f"""
    SELECT CAST(news_id AS VARCHAR) AS external_id, title, {sql_time("published_at")},
           coalesce(related || ',', '') || 'S2' AS tickers FROM news"""))
def vendor_catalogue_news(m):
    """Ticker arrays that mix strings, objects and empty values."""
    body = F.to_json(F.struct(
        F.col("news_id").cast("string").alias("id"), "title",
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_utc"),
        F.col("summary").alias("description")))
    mixed = F.concat(F.lit(',"tickers":["'), F.coalesce("related", F.lit("")),
                     F.lit('",{"ticker":"S2"},{},""]}'))
    raw = m.news().select(body.alias("b"), mixed.alias("t")).select(
        F.concat(F.expr("substring(b, 1, length(b) - 1)"), "t").alias("payload"))
    return vendor.catalogue_news(raw).select("external_id", "title", time_text("published_at"),
                                             F.array_join("tickers", ",").alias("tickers"))


@query("feed_keyword_search", "A14", with_views("news", f"""
    SELECT CAST(news_id AS VARCHAR) AS external_id, title, {sql_time("published_at")}
    FROM news WHERE contains(lower(title || ' ' || summary), 'dividend')
    ORDER BY published_at DESC, CAST(news_id AS VARCHAR) LIMIT 20"""))
def feed_keyword_search(m):
    # fixed newest-20 result page of the search
    hits = vendor.search_feed(vendor.feed_news(feed_payloads(m)), "Dividend", 20)
    return hits.select("external_id", "title", time_text("published_at"))


def macro_payloads(m):
    value = F.when(F.month("ts") == 6, F.lit(".")).otherwise(F.col("value").cast("string"))
    obs = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))
    return m.macro().groupBy("indicator").agg(F.to_json(F.struct(
        F.lit("Percent").alias("units"), F.lit("Monthly").alias("frequency"),
        F.collect_list(obs).alias("observations"))).alias("payload"))


@query("vendor_macro_observations", "A15 D4 N7", with_views("macro", f"""
    SELECT indicator, {sql_day("ts")}, value, 'Percent' AS unit, 'Monthly' AS frequency
    FROM macro WHERE month(ts) <> 6"""))
def vendor_macro_observations(m):
    rows = validation.accepted(validation.check(vendor.macro_observations(macro_payloads(m)),
                                                validation.macro_rules()))
    return rows.select("indicator", day_text("ts"), "value", "unit", "frequency")


@query("macro_catalogue_coverage", "A16", with_views("macro", """
    SELECT c.indicator, c.series_id, count(m.value) AS observations
    FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in vendor.MACRO_CATALOGUE.items()) + """)
         c(indicator, series_id) LEFT JOIN macro m USING (indicator) GROUP BY ALL"""))
def macro_catalogue_coverage(m):
    cat = m.spark.createDataFrame(list(vendor.MACRO_CATALOGUE.items()), "indicator STRING, series_id STRING")
    counts = m.macro().groupBy("indicator").agg(F.count("value").alias("n"))
    return F.broadcast(cat).join(counts, "indicator", "left").select(
        "indicator", "series_id", F.coalesce("n", F.lit(0)).alias("observations"))


def family_payloads(m, family):
    """Vendor statement arrays; each family lacks one quarter-end month so the merge must be outer."""
    gap = {"income": 3, "balance": 6, "cashflow": 9}[family]
    rows = m.statements().filter((F.col("period_type") == "quarterly")
                                 & (F.month(F.to_date("period")) != gap))
    item = F.struct(
        F.col("period").alias("date"),
        F.concat(F.lit("Q"), F.quarter(F.to_date("period")).cast("string")).alias("period"),
        F.when(F.lit(family) == "income", F.lit("")).otherwise(F.lit("EUR")).alias("reportedCurrency"),
        F.concat(F.lit(family), F.lit("/"), "period").alias("link"),
        F.when(F.lit(family) != "balance", F.col("period")).alias("fillingDate"),
        *[F.col(c).alias(v) for v, c in vendor.STATEMENT_FIELDS[family].items()])
    return _payload(rows, ["company_id"], item)


_STMT = ["revenue", "net_income", "eps", "total_assets", "total_debt", "operating_cash_flow", "free_cash_flow"]


@query("merged_statements", "A17 C10 C11 D2 H12 N6", with_views("statements", f"""
    SELECT company_id, period, 'quarterly' AS period_type,
           CASE WHEN mo <> 3 THEN revenue END AS revenue, CASE WHEN mo <> 3 THEN net_income END AS net_income,
           round(CASE WHEN mo <> 3 THEN eps END, 6) AS eps,
           CASE WHEN mo <> 6 THEN total_assets END AS total_assets,
           CASE WHEN mo <> 6 THEN total_debt END AS total_debt,
           CASE WHEN mo <> 9 THEN operating_cash_flow END AS operating_cash_flow,
           CASE WHEN mo <> 9 THEN free_cash_flow END AS free_cash_flow,
           'EUR' AS currency, period AS filed_date,
           CASE WHEN mo <> 3 THEN 'income/' || period ELSE 'balance/' || period END AS source_id
    FROM (SELECT *, month(CAST(period AS DATE)) AS mo FROM statements WHERE period_type = 'quarterly')"""))
def merged_statements(m):
    parts = {f: vendor.statement_family(family_payloads(m, f), f) for f in statements.FAMILIES}
    merged = statements.merge_families(parts["income"], parts["balance"], parts["cashflow"])
    good = validation.accepted(validation.check(merged, validation.statement_rules()))
    return good.select("company_id", "period", "period_type", *[c for c in _STMT if c != "eps"], *rnd("eps"),
                       "currency", "filed_date", "source_id")


@query("period_type_labels", "C11", with_views("statements", """
    SELECT label, kind, count(*) AS n FROM (
      SELECT CASE k WHEN 0 THEN 'Q' || quarter(d) WHEN 1 THEN 'FY' || year(d) WHEN 2 THEN 'Q4 FY'
                    ELSE substr(period, 6, 2) END AS label,
             CASE k WHEN 0 THEN 'quarterly' WHEN 1 THEN 'annual' WHEN 2 THEN 'quarterly'
                    ELSE CASE WHEN month(d) IN (3, 6, 9) THEN 'quarterly' ELSE 'annual' END END AS kind
      FROM (SELECT *, CAST(period AS DATE) AS d FROM statements), range(4) t(k)) GROUP BY ALL"""))
def period_type_labels(m):
    d = F.to_date("period")
    s = m.statements().select("period", F.explode(F.array(
        F.struct(F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("raw"),
                 F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("label")),
        F.struct(F.concat(F.lit("FY"), F.year(d).cast("string")).alias("raw"),
                 F.concat(F.lit("FY"), F.year(d).cast("string")).alias("label")),
        F.struct(F.lit("Q4 FY").alias("raw"), F.lit("Q4 FY").alias("label")),
        F.struct(F.col("period").alias("raw"), F.substring("period", 6, 2).alias("label")))).alias("p"))
    return (s.groupBy(F.col("p.label").alias("label"), vendor.period_type_of(F.col("p.raw")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n")))


def filing_payloads(m):
    """Nested filing facts: durations, instants, a restated revenue and a year-to-date row."""
    s = m.statements().repartition("company_id").withColumn("e", F.to_date("period")).withColumn(
        "days", F.when(F.col("period_type") == "quarterly", 91).otherwise(364))
    form = F.when(F.col("period_type") == "annual", "10-K").otherwise("10-Q")

    def point(value, days=F.col("days"), filed=30, start=True, form=form):
        return F.struct(
            (F.date_format(F.date_sub("e", days), "yyyy-MM-dd") if start else F.lit(None).cast("string")).alias("start"),
            F.col("period").alias("end"), value.cast("double").alias("val"), form.alias("form"),
            F.date_format(F.date_add("e", filed), "yyyy-MM-dd").alias("filed"),
            F.concat(F.lit(f"a{filed}-"), "period").alias("accn"),
            F.when(F.col("period_type") == "annual", "FY").otherwise(
                F.concat(F.lit("Q"), F.quarter("e").cast("string"))).alias("fp"), F.year("e").alias("fy"))

    entry = lambda alias, unit, p: F.struct(F.lit(alias).alias("alias"), F.lit(unit).alias("unit"), p.alias("p"))
    rows = s.select("company_id", F.explode(F.array(
        entry("Revenues", "USD", point(F.col("revenue"))),
        entry("Revenues", "USD", point(F.col("revenue") * 2, filed=60)),
        entry("Revenues", "USD", point(F.col("revenue") * 9, days=F.lit(180), filed=90)),
        entry("Revenues", "USD", point(F.col("revenue") * 7, filed=120, form=F.lit("8-K"))),
        entry("NetIncomeLoss", "USD", point(F.col("net_income"))),
        entry("EarningsPerShareBasic", "USD/shares", point(F.col("eps"))),
        entry("Assets", "USD", point(F.col("total_assets"), start=False)),
        entry("LongTermDebt", "USD", point(F.col("total_debt") * 3, start=False)),
        entry("DebtLongtermAndShorttermCombined", "USD", point(F.col("total_debt"), start=False)),
        entry("NetCashProvidedByUsedInOperatingActivities", "USD", point(F.col("operating_cash_flow"))),
        entry("PaymentsToAcquirePropertyPlantAndEquipment", "USD", point(F.col("cash"))))).alias("x")).select("company_id", "x.*")
    units = rows.groupBy("company_id", "alias", "unit").agg(F.collect_list("p").alias("points"))
    concepts = units.groupBy("company_id", "alias").agg(
        F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "points"))).alias("units")).alias("c"))
    return concepts.groupBy("company_id").agg(F.to_json(F.struct(F.struct(
        F.map_from_entries(F.collect_list(F.struct("alias", "c"))).alias("us-gaap")).alias("facts"))).alias("payload"))


@query("filing_statements", "A19 C9", with_views("statements", """
    SELECT company_id, period, period_type, round(revenue * 2, 4) AS revenue, net_income, round(eps, 6) AS eps,
           total_assets, total_debt, operating_cash_flow, -abs(cash) AS capital_expenditure,
           round(operating_cash_flow - cash, 4) AS free_cash_flow,
           strftime(CAST(period AS DATE) + INTERVAL 60 DAY, '%Y-%m-%d') AS filed_date,
           'a60-' || period AS source_id
    FROM (SELECT * REPLACE (coalesce(any_total, total_assets) AS total_assets, coalesce(any_debt, total_debt) AS total_debt)
          FROM (SELECT s.*, max(total_assets) OVER w AS any_total, max(total_debt) OVER w AS any_debt
                FROM statements s WINDOW w AS (PARTITION BY company_id, period)))"""))
def filing_statements(m):
    """A year-end carries a quarterly and an annual instant in one filing; the larger one stands for both."""
    out = vendor.filing_statements(filing_payloads(m))
    return out.select("company_id", "period", "period_type", *rnd("revenue", digits=4), "net_income", *rnd("eps"),
                      "total_assets", "total_debt", "operating_cash_flow", "capital_expenditure",
                      *rnd("free_cash_flow", digits=4), "filed_date", "source_id")


@query("filing_concepts", "A18", with_views("statements", """
    SELECT concept, form, unit, CAST(count(*) AS BIGINT) AS points, round(sum(value * CASE WHEN concept <> 'revenue' OR k = 0 THEN 1 WHEN k = 1 THEN 2 ELSE 9 END), 0) AS total FROM (
      SELECT unnest([
        {'concept': 'revenue', 'unit': 'USD', 'value': revenue},
        {'concept': 'net_income', 'unit': 'USD', 'value': net_income},
        {'concept': 'eps', 'unit': 'USD/shares', 'value': eps},
        {'concept': 'total_assets', 'unit': 'USD', 'value': total_assets},
        {'concept': 'total_debt', 'unit': 'USD', 'value': total_debt * 3},
        {'concept': 'operating_cash_flow', 'unit': 'USD', 'value': operating_cash_flow},
        {'concept': 'capital_expenditure', 'unit': 'USD', 'value': cash}], recursive := true),
        CASE WHEN period_type = 'annual' THEN '10-K' ELSE '10-Q' END AS form,
      FROM statements) x, range(3) t(k) WHERE k = 0 OR concept = 'revenue'
    GROUP BY ALL"""))
def filing_concepts(m):
    rows = vendor.filing_concepts(filing_payloads(m))
    return rows.groupBy("concept", "form", "unit").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 0).alias("total"))


@query("vendor_ownership", "A20", """
    SELECT 'S' || l_suppkey AS ticker, kind, count(*) AS n, round(sum(l_quantity), 4) AS shares,
           round(sum(l_extendedprice), 2) AS value
    FROM lineitem, (VALUES ('insider'), ('institution')) k(kind) GROUP BY ALL""")
def vendor_ownership(m):
    """Insider and fund records packed by (company, ship day, order bucket), so no payload holds a large company's month; then parsed."""
    li = m.table("lineitem").withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    date = F.date_format("l_shipdate", "yyyy-MM-dd")
    base = [F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_quantity").alias("share"),
            F.col("l_extendedprice").alias("value"), F.col("l_tax").alias("change")]
    pack = lambda *c: (li.groupBy("ticker", date.alias("day"), F.pmod("l_orderkey", F.lit(16)).alias("part"))
                       .agg(F.to_json(F.struct(F.collect_list(F.struct(*base, *c)).alias("data"))).alias("payload")))
    insider = vendor.insider_transactions(pack(
        date.alias("transactionDate"), F.col("l_returnflag").alias("transactionCode"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("transactionPrice")))
    fund = vendor.institutional_ownership(pack(date.alias("filingDate")))
    both = insider.select("ticker", F.lit("insider").alias("kind"), "shares", "value").unionByName(
        fund.select("ticker", F.lit("institution").alias("kind"), "shares", "value"))
    return both.groupBy("ticker", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("shares"), 4).alias("shares"),
        F.round(F.sum("value"), 2).alias("value"))


@query("vendor_mover_lists", "A21", with_views("bar_rows companies", """
    SELECT CASE WHEN close >= prev THEN 'gainer' ELSE 'loser' END AS side, ticker, name, close AS price,
           round((close - prev) / prev * 100, 6) AS change_percent, volume
    FROM bar_rows JOIN companies USING (company_id) WHERE age = 1"""))
def vendor_mover_lists(m):
    from tallyvane.operators.indicators import quote_change

    q = quote_change(m.bars()).join(m.companies(), "company_id")
    item = F.to_json(F.array(F.struct(
        F.col("ticker").alias("symbol"), "name", "price", F.col("change_percent").alias("changesPercentage"), "volume")))
    rows = q.select(item.alias("payload"), (F.col("change") >= 0).alias("up"))
    out = vendor.mover_lists(rows.filter("up"), rows.filter("NOT up"))
    return out.select("side", "ticker", "name", "price", *rnd("change_percent"), "volume")


@query("vendor_quotes", "A22", with_views("bar_rows", """
    SELECT 'S' || company_id AS ticker, close AS price, round(close - prev, 6) AS change,
           round((close - prev) / prev * 100, 6) AS change_percent, volume
    FROM bar_rows WHERE age = 1 AND company_id % 9 <> 0"""))
def vendor_quotes(m):
    """Percent is absent from the payload, and every ninth company quotes price 0."""
    from tallyvane.operators.indicators import quote_change

    q = quote_change(m.bars())
    payload = F.to_json(F.struct(
        F.when(F.col("company_id") % 9 == 0, 0.0).otherwise(F.col("price")).alias("price"), "change", "volume"))
    rows = q.select(F.concat(F.lit("S"), F.col("company_id").cast("string")).alias("ticker"), payload.alias("payload"))
    return vendor.quotes(rows).select("ticker", "price", *rnd("change", "change_percent"), "volume")


@query("raw_landing", "A15", with_views("macro", """
    SELECT 'fred' AS provider, '/series/observations' AS endpoint, indicator, count(*) AS observations
    FROM macro GROUP BY indicator"""))
def raw_landing(m):
    """Rows as ``writers.land_raw`` stores them, read back as open-shape values."""
    raw = macro_payloads(m).select(F.lit("fred").alias("provider"), F.lit("/series/observations").alias("endpoint"),
                                   "indicator", F.parse_json("payload").alias("payload"))
    items = F.variant_get("payload", "$.observations", "array<variant>")
    return raw.select("provider", "endpoint", "indicator", F.size(items).cast("long").alias("observations"))


@query("bar_upsert_counts", "B2 C6", with_views("bars", """
    SELECT company_id, count(*) FILTER (year(ts) >= 2000) AS inserted,
           count(*) + count(*) FILTER (day(ts) = 1) - count(*) FILTER (year(ts) >= 2000) AS skipped
    FROM bars GROUP BY company_id"""))
def bar_upsert_counts(m):
    """Bars before 2000 are stored; the batch repeats them and doubles every first of a month."""
    bars = m.bars().withColumn("interval", F.lit("1d"))
    incoming = bars.withColumn("seq", F.lit(0)).unionByName(
        bars.filter(F.dayofmonth("ts") == 1).withColumn("seq", F.lit(1)).withColumn("close", F.lit(0.0)))
    # intraday stamps snap to the day before the key is compared
    incoming = incoming.withColumn("ts", F.date_trunc("day", F.timestamp_seconds(F.unix_timestamp("ts") + 3600)))
    stored = bars.filter(F.year("ts") < 2000)
    added = upsert.new_rows(incoming, stored, ["company_id", "interval", "ts"], "seq")
    return upsert.insert_counts(incoming, added, ["company_id"])


@query("statement_upsert_counts", "B3", with_views("statements", """
    SELECT period_type, count(*) FILTER (period >= '1999') AS inserted,
           count(*) FILTER (period < '1999') AS skipped FROM statements GROUP BY 1"""))
def statement_upsert_counts(m):
    s = m.statements().withColumn("seq", F.lit(0))
    added = upsert.new_rows(s, s.filter("period < '1999'"), ["company_id", "period", "period_type"], "seq")
    return upsert.insert_counts(s, added, ["period_type"])


@query("macro_upsert_counts", "B4 N7", with_views("macro", """
    SELECT indicator, count(*) FILTER (year(ts) >= 1998) AS inserted,
           count(*) FILTER (year(ts) < 1998) AS skipped FROM macro GROUP BY 1"""))
def macro_upsert_counts(m):
    x = m.macro().withColumn("seq", F.lit(0))
    added = upsert.new_rows(x, x.filter(F.year("ts") < 1998), ["indicator", "ts"], "seq")
    return upsert.insert_counts(x, added, ["indicator"])


def hashed_news(m):
    iso = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")
    return m.news().withColumn("content_hash", ids.news_hash(F.col("summary"), iso, "external_id", "source"))


_NEWS_HASH = """sha256(CASE WHEN external_id IS NOT NULL
    THEN source || '|' || external_id || '|' || lower(trim(summary, ' '))
    ELSE lower(trim(summary, ' ')) || '|' || strftime(published_at, '%Y-%m-%d %H:%M:%S') END)"""


@query("news_dedup_hash", "C8 B10", with_views("news", f"""
    SELECT news_id, {_NEWS_HASH} AS content_hash FROM news"""))
def news_dedup_hash(m):
    return hashed_news(m).select("news_id", "content_hash")


@query("news_content_hash", "C7", with_views("news", """
    SELECT news_id, sha256(title || '|' || url || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00')) AS content_hash
    FROM news"""))
def news_content_hash(m):
    iso = F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return m.news().select("news_id", ids.content_hash("title", "url", iso).alias("content_hash"))


def syndicated(m):
    """The same articles arriving twice: once as themselves, once under a shared hash key (the text)."""
    n = m.news().select("news_id", "source", "external_id",
                        F.sha2(F.lower(F.col("summary")), 256).alias("content_hash"))
    return n


add_view("text_first", "news", """
    SELECT news_id, source, external_id, sha256(lower(summary)) AS content_hash,
           coalesce('id|' || source || '|' || external_id, 'hash|' || sha256(lower(summary))) AS key
    FROM news""")


@query("news_insert_survivors", "B5 B15 B19", with_views("text_first", """
    SELECT t.news_id FROM (SELECT key, min(news_id) AS news_id FROM text_first GROUP BY key) f
    JOIN text_first t USING (news_id)
    WHERE t.content_hash NOT IN (SELECT content_hash FROM text_first WHERE news_id % 10 = 1)
      AND (t.external_id IS NULL OR (t.source, t.external_id) NOT IN
           (SELECT (source, external_id) FROM text_first WHERE news_id % 10 = 1 AND external_id IS NOT NULL))"""))
def news_insert_survivors(m):
    """A tenth of the articles is stored already; exact copies collapse to the first."""
    rows = syndicated(m)
    return upsert.new_news(rows, rows.filter(F.col("news_id") % 10 == 1), "news_id").select("news_id")


@query("news_existing_match", "B6", with_views("text_first", """
    SELECT t.news_id, coalesce(i.news_id, h.news_id) AS survivor FROM text_first t
    LEFT JOIN (SELECT source, external_id, min(news_id) AS news_id FROM text_first
               WHERE external_id IS NOT NULL GROUP BY ALL) i USING (source, external_id)
    LEFT JOIN (SELECT content_hash, min(news_id) AS news_id FROM text_first GROUP BY ALL) h USING (content_hash)"""))
def news_existing_match(m):
    rows = syndicated(m)
    return upsert.surviving_news(rows, rows, "news_id").select("news_id", "survivor")


@query("collapsed_duplicates", "B8", with_views("text_first", """
    SELECT max(news_id) AS news_id, external_id, content_hash FROM text_first GROUP BY content_hash, external_id"""))
def collapsed_duplicates(m):
    out = upsert.collapse_duplicates(syndicated(m), ["content_hash", "external_id"], "news_id")
    return out.select("news_id", "external_id", "content_hash")


@query("duplicate_probes", "B10", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, close, year(ts) < 2000 AND day(ts) <> 7 AS is_duplicate FROM bars"""))
def duplicate_probes(m):
    bars = m.bars()
    stored = bars.filter((F.year("ts") < 2000) & (F.dayofmonth("ts") != 7))
    return upsert.mark_existing(bars, stored, ["company_id", "ts"]).select(
        "company_id", day_text("ts"), "close", "is_duplicate")


@query("identifier_forms", "C1 C2 C3 C13", with_views("companies", """
    SELECT company_id, ticker AS from_exchange, ticker AS from_country, lower(name) AS plain_name,
           true AS valid, upper(substr(industry, 1, 4)) AS short_id, 'candidate-' || company_id AS long_id
    FROM companies"""))
def identifier_forms(m):
    c = m.companies()
    return c.select(
        "company_id",
        ids.normalize_ticker(F.concat(F.lit("NASDAQ:"), F.lower("ticker"))).alias("from_exchange"),
        ids.normalize_ticker(F.concat(F.lit(" "), "ticker", F.lit(".US "))).alias("from_country"),
        ids.normalize_company_name(F.concat("name", F.lit(" Co. Inc"))).alias("plain_name"),
        ids.valid_ticker("ticker").alias("valid"),
        ids.normalizer_chain(F.concat(F.lit(" "), F.lower(F.substring("industry", 1, 4)), F.lit(" ")), []).alias("short_id"),
        ids.normalizer_chain(F.concat(F.lit("candidate-"), F.col("company_id").cast("string")),
                             []).alias("long_id"))


def with_identifiers(m):
    key = F.lpad(F.col("company_id").cast("string"), 9, "0")
    return m.companies().withColumns({
        "cik": F.lpad(F.col("company_id").cast("string"), 10, "0"),
        "isin": F.concat(F.lit("US"), key), "cusip": F.concat(F.lit("C"), key)})


@query("resolve_companies", "E14", with_views("companies facts", """
    SELECT o_orderkey AS request_id,
           CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_custkey % n_companies END AS company_id,
           CASE o_orderkey % 5 WHEN 0 THEN 'ticker' WHEN 1 THEN 'cik' WHEN 2 THEN 'isin' WHEN 3 THEN 'cusip' END AS matched_on
    FROM orders, facts"""))
def resolve_companies(m):
    """One request per order, each carrying one kind of identifier (every fifth an unknown one)."""
    c = F.col("o_custkey") % m.n_companies
    kind, text = F.col("o_orderkey") % 5, c.cast("string")
    nine = F.lpad(text, 9, "0")
    req = m.table("orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(kind == 0, F.concat(F.lit("NYSE:s"), text)).when(kind == 4, "UNKNOWN").alias("ticker"),
        F.when(kind == 1, text).alias("cik"),
        F.when(kind == 2, F.concat(F.lit("us"), nine)).alias("isin"),
        F.when(kind == 3, F.concat(F.lit("c"), nine)).alias("cusip"))
    return linking.resolve_companies(req, with_identifiers(m)).select("request_id", "company_id", "matched_on")


@query("resolve_or_create", "E15", with_views("companies", """
    SELECT 'S' || k AS ticker, CASE WHEN k < n AND k % 2 = 0 THEN sector ELSE 'NEW' END AS sector
    FROM (SELECT unnest(range(0, n + 10)) AS k, n FROM (SELECT count(*) AS n FROM companies))
    LEFT JOIN companies ON company_id = k"""))
def resolve_or_create(m):
    """Odd companies lack a sector, and ten more tickers arrive than are stored."""
    stored = m.companies().select(
        "ticker", F.when(F.col("company_id") % 2 == 0, F.col("sector")).otherwise("").alias("sector"))
    extra = m.spark.range(m.n_companies, m.n_companies + 10).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("ticker"))
    incoming = m.companies().select("ticker").unionByName(extra).withColumn("sector", F.lit("NEW"))
    return upsert.fill_missing(stored, incoming, "ticker", ["sector"])


@query("cik_lookup", "E22", with_views("companies", """
    SELECT ticker, lpad(CAST(company_id * 7 AS VARCHAR), 10, '0') AS cik FROM companies"""))
def cik_lookup(m):
    index = m.companies().select(F.lower("ticker").alias("ticker"), (F.col("company_id") * 7).alias("cik_str"))
    return linking.cik_lookup(m.companies().select("ticker"), index)


@query("profile_merge", "C27", with_views("companies", """
    SELECT company_id, CASE WHEN company_id % 3 = 0 THEN name ELSE upper(name) END AS name,
           CASE WHEN company_id % 4 = 0 THEN s_acctbal * 1000000 ELSE abs(s_acctbal) END AS market_cap
    FROM companies JOIN supplier ON s_suppkey = company_id"""))
def profile_merge(m):
    """Names from the profile when present; market cap from the second source (in millions) when absent."""
    base = m.companies().select("company_id", "name")
    sup = m.table("supplier").select(F.col("s_suppkey").alias("company_id"), "s_acctbal")
    profile = m.companies().select(
        "company_id", F.when(F.col("company_id") % 3 == 0, "").otherwise(F.upper("name")).alias("name"))
    merged = upsert.overlay_profile(base, profile, "company_id", ["name"])
    first = F.when(F.col("company_id") % 4 != 0, F.abs("s_acctbal"))
    return merged.join(sup, "company_id").select(
        "company_id", "name", F.coalesce(first, F.col("s_acctbal") * 1_000_000).alias("market_cap"))


@query("heartbeat_merge", "B9", """
    SELECT user_id, strftime(max(ts) FILTER (event_type IN ('view', 'click')), '%Y-%m-%d %H:%M:%S') AS last_success_at,
           strftime(coalesce(max(ts) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'),
                             max(ts) FILTER (event_type = 'error' AND ts < TIMESTAMP '2024-01-15')), '%Y-%m-%d %H:%M:%S') AS last_failure_at
    FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id""")
def heartbeat_merge(m):
    """First half of the event log is stored, the second half arrives; NULLs never erase a time."""
    ev = m.table("events").filter(F.col("event_type").isin("view", "click", "error")).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    cut = F.lit("2024-01-15").cast("timestamp")

    def beats(df):
        return df.groupBy("user_id").agg(
            F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success_at"),
            F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_failure_at"))

    out = upsert.merge_keep_old(beats(ev.filter(F.col("ts") < cut)), beats(ev.filter(F.col("ts") >= cut)),
                                ["user_id"], ["last_success_at", "last_failure_at"])
    return out.select("user_id", time_text("last_success_at"), time_text("last_failure_at"))
