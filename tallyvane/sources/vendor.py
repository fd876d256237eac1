"""Vendor payloads (raw JSON text) to typed rows.

Input is always a DataFrame of raw payload strings, one payload per row, so
parsing is parallel over payloads. Schemas are explicit; bad values become NULL
through ``try_cast`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions.times import parse_timestamp
from tallyvane.operators.latest import top_per_key

_BAR = "STRUCT<datetime: STRING, open: STRING, high: STRING, low: STRING, close: STRING, volume: STRING>"

# fixed values: macro indicator -> published series id
MACRO_CATALOGUE = {
    "fed_funds_rate": "FEDFUNDS",
    "cpi": "CPIAUCSL",
    "core_cpi": "CPILFESL",
    "ppi": "PPIACO",
    "gdp": "GDP",
    "real_gdp": "GDPC1",
    "unemployment_rate": "UNRATE",
    "treasury_3m": "DGS3MO",
    "treasury_2y": "DGS2",
    "treasury_10y": "DGS10",
    "treasury_30y": "DGS30",
    "money_supply_m2": "M2SL",
    "consumer_sentiment": "UMCSENT",
    "industrial_production": "INDPRO",
    "housing_starts": "HOUST",
    "vix": "VIXCLS",
}

# fixed values: filing concept aliases, first present wins (long-row extraction)
CONCEPT_ALIASES = {
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss",),
    "eps": ("EarningsPerShareBasic",),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "total_debt": ("LongTermDebt", "DebtLongtermAndShorttermCombined"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "shareholders_equity": ("StockholdersEquity",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "capital_expenditure": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "free_cash_flow": ("FreeCashFlow",),
}
# fixed values: where the canonical statement builder prefers the other alias order
CANONICAL_ALIASES = {
    **{k: v for k, v in CONCEPT_ALIASES.items() if k != "free_cash_flow"},
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"),
    "total_debt": ("DebtLongtermAndShorttermCombined", "LongTermDebt"),
}

_POINT = ("STRUCT<start: STRING, `end`: STRING, val: DOUBLE, form: STRING, filed: STRING, "
          "accn: STRING, fp: STRING, fy: INT>")
FACTS_SCHEMA = ("STRUCT<facts: STRUCT<`us-gaap`: MAP<STRING, STRUCT<units: "
                f"MAP<STRING, ARRAY<{_POINT}>>>>>>")


def _num(c: str) -> Column:
    return F.col(c).try_cast("double")


def paged_bars(payloads: DataFrame) -> DataFrame:
    """(company_id, page, payload) with string fields -> bars; the last page wins per time."""
    rows = (
        payloads.select("company_id", "page",
                        F.explode(F.from_json("payload", f"STRUCT<values: ARRAY<{_BAR}>>")["values"]).alias("b"))
        .select("company_id", "page", "b.*")
        .withColumn("ts", parse_timestamp("datetime"))
        .filter(F.col("ts").isNotNull())
    )
    rows = top_per_key(rows, ["company_id", "ts"], [F.desc("page")])
    volume = F.bround(F.coalesce(_num("volume"), F.lit(0.0))).cast("long")
    return rows.select("company_id", "ts", *[_num(c).alias(c) for c in ("open", "high", "low", "close")],
                       _num("close").alias("adjusted_close"), volume.alias("volume"))


def column_bars(payloads: DataFrame) -> DataFrame:
    """Parallel arrays t/o/h/l/c/v; payloads whose status is not ok yield nothing."""
    schema = "STRUCT<s: STRING, t: ARRAY<BIGINT>, o: ARRAY<DOUBLE>, h: ARRAY<DOUBLE>, " \
             "l: ARRAY<DOUBLE>, c: ARRAY<DOUBLE>, v: ARRAY<DOUBLE>>"
    j = payloads.select("company_id", F.from_json("payload", schema).alias("j")).filter("j.s = 'ok'")
    rows = j.select("company_id", "j", F.posexplode("j.t").alias("i", "t"))
    at = lambda k: F.get(F.col(f"j.{k}"), F.col("i"))
    return rows.select(
        "company_id", parse_timestamp(F.col("t").cast("string")).alias("ts"),
        at("o").alias("open"), at("h").alias("high"), at("l").alias("low"), at("c").alias("close"),
        at("c").alias("adjusted_close"),
        F.bround(F.coalesce(at("v"), F.lit(0.0))).cast("long").alias("volume"))


def dated_bars(payloads: DataFrame) -> DataFrame:
    """Row objects keyed by ``date``, newest first; missing adjClose falls back to close."""
    item = "STRUCT<date: STRING, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, " \
           "adjClose: DOUBLE, volume: DOUBLE>"
    rows = payloads.select(
        "company_id", F.explode(F.from_json("payload", f"STRUCT<historical: ARRAY<{item}>>")["historical"]).alias("b"))
    return rows.select(
        "company_id", parse_timestamp("b.date").alias("ts"), "b.open", "b.high", "b.low", "b.close",
        F.coalesce("b.adjClose", "b.close").alias("adjusted_close"),
        F.bround(F.coalesce("b.volume", F.lit(0.0))).cast("long").alias("volume"))


def short_key_bars(payloads: DataFrame) -> DataFrame:
    """Row objects with one-letter keys and epoch milliseconds."""
    item = "STRUCT<t: BIGINT, o: DOUBLE, h: DOUBLE, l: DOUBLE, c: DOUBLE, v: DOUBLE>"
    rows = payloads.select(
        "company_id", F.explode(F.from_json("payload", f"STRUCT<results: ARRAY<{item}>>")["results"]).alias("b"))
    return rows.select(
        "company_id", parse_timestamp(F.col("b.t").cast("string")).alias("ts"),
        F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
        F.col("b.c").alias("close"), F.col("b.c").alias("adjusted_close"),
        F.bround(F.coalesce("b.v", F.lit(0.0))).cast("long").alias("volume"))


def feed_news(payloads: DataFrame) -> DataFrame:
    """News objects whose related tickers are one comma separated string."""
    item = "STRUCT<id: STRING, headline: STRING, url: STRING, datetime: STRING, summary: STRING, " \
           "related: STRING, sentiment: DOUBLE>"
    r = payloads.select(F.from_json("payload", item).alias("r")).select("r.*")
    tickers = F.filter(F.transform(F.split(F.coalesce("related", F.lit("")), ","),
                                   lambda t: F.trim(t)),
                       lambda t: t != "")
    return r.select(
        F.coalesce("id", F.lit("")).alias("external_id"), F.lit("finnhub").alias("source"),
        F.coalesce("headline", F.lit("")).alias("title"), "url",
        parse_timestamp("datetime").alias("published_at"), "summary",
        F.col("summary").alias("content"), tickers.alias("tickers"), "sentiment")


def catalogue_news(payloads: DataFrame) -> DataFrame:
    """News objects whose tickers are an array of strings and/or ``{"ticker": ...}`` objects."""
    item = "STRUCT<id: STRING, title: STRING, article_url: STRING, published_utc: STRING, " \
           "description: STRING, tickers: ARRAY<STRING>, sentiment: DOUBLE>"
    r = payloads.select(F.from_json("payload", item).alias("r")).select("r.*")
    tickers = F.filter(
        F.transform(F.coalesce("tickers", F.array().cast("array<string>")),
                    lambda t: F.when(F.startswith(t, F.lit("{")), F.get_json_object(t, "$.ticker")).otherwise(t)),
        lambda t: t.isNotNull() & (t != ""))
    return r.select(
        F.coalesce("id", F.lit("")).alias("external_id"), F.lit("massive").alias("source"),
        F.coalesce("title", F.lit("")).alias("title"), F.col("article_url").alias("url"),
        parse_timestamp("published_utc").alias("published_at"), F.col("description").alias("summary"),
        F.lit(None).cast("string").alias("content"), tickers.alias("tickers"), "sentiment")


def search_feed(news: DataFrame, text: str, limit: int) -> DataFrame:
    """Newest ``limit`` items whose title or summary contains ``text``."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    return (news.filter(F.contains(hay, F.lit(text.lower())))
            .orderBy(F.desc("published_at"), "external_id").limit(limit))


def macro_observations(payloads: DataFrame) -> DataFrame:
    """Observation lists; "." marks a missing value and is dropped."""
    schema = "STRUCT<units: STRING, frequency: STRING, observations: ARRAY<STRUCT<date: STRING, value: STRING>>>"
    j = payloads.select("indicator", F.from_json("payload", schema).alias("j"))
    return (
        j.select("indicator", "j.units", "j.frequency", F.explode("j.observations").alias("o"))
        .filter(F.coalesce("o.value", F.lit(".")) != ".")
        .select("indicator", parse_timestamp("o.date").alias("ts"),
                F.col("o.value").try_cast("double").alias("value"),
                F.coalesce("units", F.lit("")).alias("unit"),
                F.coalesce("frequency", F.lit("")).alias("frequency"), F.lit("FRED").alias("source"))
    )


def period_type_of(label) -> Column:
    """quarterly / annual from a fiscal label, else from the month of a date label."""
    p = F.upper(F.coalesce(label, F.lit("")))
    month = F.regexp_extract(p, r"-(\d{2})-", 1)
    return (F.when(F.contains(p, F.lit("Q")) & ~F.startswith(p, F.lit("FY")), "quarterly")
            .when(F.startswith(p, F.lit("FY")) | F.endswith(p, F.lit("Y")), "annual")
            .when(month.isin("03", "06", "09"), "quarterly")
            .otherwise("annual"))


# fixed values: vendor field -> canonical field, per statement family
STATEMENT_FIELDS = {
    "income": {"revenue": "revenue", "grossProfit": "gross_profit", "operatingIncome": "operating_income",
               "netIncome": "net_income", "eps": "eps"},
    "balance": {"totalAssets": "total_assets", "totalLiabilities": "total_liabilities",
                "totalDebt": "total_debt", "cashAndCashEquivalents": "cash",
                "totalStockholdersEquity": "shareholders_equity"},
    "cashflow": {"operatingCashFlow": "operating_cash_flow", "capitalExpenditure": "capital_expenditure",
                 "freeCashFlow": "free_cash_flow"},
}


def statement_family(payloads: DataFrame, family: str) -> DataFrame:
    """One vendor statement family (JSON array per company) in canonical fields."""
    fields = STATEMENT_FIELDS[family]
    item = ("STRUCT<date: STRING, period: STRING, reportedCurrency: STRING, link: STRING, fillingDate: STRING, "
            + ", ".join(f"{v}: DOUBLE" for v in fields) + ">")
    r = payloads.select("company_id", F.explode(F.from_json("payload", f"ARRAY<{item}>")).alias("r"))
    return r.select(
        "company_id", F.coalesce("r.date", F.lit("")).alias("period"),
        period_type_of(F.coalesce("r.period", "r.date")).alias("period_type"),
        F.coalesce("r.reportedCurrency", F.lit("USD")).alias("currency"),
        *[F.col(f"r.{v}").alias(c) for v, c in fields.items()],
        F.col("r.link").alias("source_id"), F.col("r.fillingDate").alias("filed_date"))


def _alias_rows(spark, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(field, alias, i) for field, names in aliases.items() for i, alias in enumerate(names)]
    return F.broadcast(spark.createDataFrame(rows, "field STRING, alias STRING, priority INT"))


def filing_points(payloads: DataFrame) -> DataFrame:
    """Filing facts (nested maps) to one row per data point."""
    j = payloads.select("company_id", F.from_json("payload", FACTS_SCHEMA)["facts"]["us-gaap"].alias("g"))
    return (
        j.select("company_id", F.explode("g").alias("alias", "c"))
        .select("company_id", "alias", F.explode("c.units").alias("unit", "points"))
        .select("company_id", "alias", "unit", F.explode("points").alias("p"))
        .select("company_id", "alias", "unit", "p.*")
    )


def filing_concepts(payloads: DataFrame, aliases=None) -> DataFrame:
    """Long concept rows: first alias present per concept, 10-K/10-Q only, every unit."""
    points = filing_points(payloads).join(
        _alias_rows(payloads.sparkSession, aliases or CONCEPT_ALIASES), "alias")
    best = points.groupBy("company_id", "field").agg(F.min("priority").alias("priority"))
    return (
        points.join(best, ["company_id", "field", "priority"], "left_semi")
        .filter(F.col("form").isin("10-K", "10-Q"))
        .select("company_id", F.col("field").alias("concept"), F.col("val").alias("value"),
                F.col("fp").alias("period"), F.col("fy").alias("fiscal_year"), "form", "filed", "unit")
    )


def filing_statements(payloads: DataFrame) -> DataFrame:
    """Canonical statements: quarterly (70-110 d) and annual (330-380 d) durations only.

    Point-in-time facts join every duration that ends on their date; later filings
    replace earlier ones; capital expenditure is stored negative.
    """
    fields = list(CANONICAL_ALIASES)
    # payloads are parsed once, and one exchange by company serves every group below
    points = (
        filing_points(payloads)
        .join(_alias_rows(payloads.sparkSession, CANONICAL_ALIASES), "alias")
        .filter(F.col("unit") == F.when(F.col("field") == "eps", "USD/shares").otherwise("USD"))
        .repartition("company_id")
    )
    best = F.min("priority").over(Window.partitionBy("company_id", "field"))
    points = points.withColumn("_best", best).filter("priority = _best").filter(
        F.col("form").isin("10-K", "10-Q") & (F.coalesce("end", F.lit("")) != ""))
    days = F.datediff(F.to_date("end"), F.to_date("start"))
    points = points.withColumn(
        "kind", F.when(F.col("start").isNull(), "instant")
        .when(days.between(70, 110), "quarterly").when(days.between(330, 380), "annual")
    ).filter("kind IS NOT NULL")
    # a total order: one filing may state an instant twice, then the larger figure stands
    when = F.concat(F.coalesce("filed", F.lit("")), F.coalesce("accn", F.lit("")))
    latest = lambda f: F.max_by(F.when(F.col("field") == f, F.col("val")), F.when(F.col("field") == f, F.struct(when, "val")))
    wide = points.groupBy("company_id", "end", "kind").agg(
        *[latest(f).alias(f) for f in fields],
        F.max("filed").alias("filed_date"),
        F.max_by("accn", when).alias("source_id"))
    at_end = Window.partitionBy("company_id", "end")
    instant = lambda f: F.max(F.when(F.col("kind") == "instant", F.col(f))).over(at_end)
    merged = wide.withColumns({f"i_{f}": instant(f) for f in fields}).filter("kind <> 'instant'").select(
        "company_id", F.col("end").alias("period"), F.col("kind").alias("period_type"),
        *[F.coalesce(f"i_{f}", f).alias(f) for f in fields], "filed_date", "source_id")
    merged = merged.withColumn("capital_expenditure", -F.abs("capital_expenditure"))
    return merged.withColumn("free_cash_flow", F.col("operating_cash_flow") + F.col("capital_expenditure"))


def insider_transactions(payloads: DataFrame) -> DataFrame:
    item = "STRUCT<transactionDate: STRING, name: STRING, transactionCode: STRING, share: DOUBLE, " \
           "transactionPrice: DOUBLE, value: DOUBLE, change: DOUBLE>"
    r = payloads.select("ticker", F.explode(F.from_json("payload", f"STRUCT<data: ARRAY<{item}>>")["data"]).alias("t"))
    return r.select("ticker", F.col("t.transactionDate").alias("transaction_date"),
                    F.col("t.name").alias("insider_name"), F.col("t.transactionCode").alias("transaction_type"),
                    F.col("t.share").alias("shares"), F.col("t.transactionPrice").alias("price"), "t.value",
                    F.col("t.change").alias("ownership_change"))


def institutional_ownership(payloads: DataFrame) -> DataFrame:
    item = "STRUCT<filingDate: STRING, name: STRING, share: DOUBLE, value: DOUBLE, change: DOUBLE>"
    r = payloads.select("ticker", F.explode(F.from_json("payload", f"STRUCT<data: ARRAY<{item}>>")["data"]).alias("t"))
    return r.select("ticker", F.col("t.filingDate").alias("filing_date"), F.col("t.name").alias("institution"),
                    F.col("t.share").alias("shares"), "t.value", F.col("t.change").alias("percent_change"))


def mover_lists(gainers: DataFrame, losers: DataFrame) -> DataFrame:
    """Two payload lists to one table with a ``side`` column."""
    item = "STRUCT<symbol: STRING, name: STRING, price: DOUBLE, changesPercentage: DOUBLE, volume: BIGINT>"

    def rows(df: DataFrame, side: str) -> DataFrame:
        r = df.select(F.explode(F.from_json("payload", f"ARRAY<{item}>")).alias("m"))
        return r.select(
            F.lit(side).alias("side"), F.col("m.symbol").alias("ticker"), "m.name",
            F.coalesce("m.price", F.lit(0.0)).alias("price"),
            F.coalesce("m.changesPercentage", F.lit(0.0)).alias("change_percent"),
            F.coalesce("m.volume", F.lit(0)).alias("volume"))

    return rows(gainers, "gainer").unionByName(rows(losers, "loser"))


def quotes(payloads: DataFrame) -> DataFrame:
    """Quote objects; percent derived when missing, unusable prices dropped."""
    item = "STRUCT<price: DOUBLE, change: DOUBLE, changesPercentage: DOUBLE, volume: BIGINT>"
    q = payloads.select("ticker", F.from_json("payload", item).alias("q")).select(
        "ticker", F.coalesce("q.price", F.lit(0.0)).alias("price"),
        F.coalesce("q.change", F.lit(0.0)).alias("change"),
        F.coalesce("q.changesPercentage", F.lit(0.0)).alias("pct"),
        F.coalesce("q.volume", F.lit(0)).alias("volume"))
    bad = F.lit(False)
    for c in ("price", "change", "pct"):
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    derived = F.when((F.col("pct") == 0) & (F.col("change") != 0) & (F.col("price") != F.col("change")),
                     F.col("change") / (F.col("price") - F.col("change")) * 100).otherwise(F.col("pct"))
    return q.filter((F.col("price") > 0) & ~bad).select(
        "ticker", "price", "change", derived.alias("change_percent"), "volume")
