"""Market-shaped views over the driver tables.

Each view is one lazy plan. Time bounds are passed as literals and applied to
the raw file column, so they prune row groups in the scan. Bars are a single
partial-aggregable ``groupBy``: a supplier that owns a third of all trades is
reduced on the map side to at most one row per trading day, and every
per-company window downstream works on calendar-bounded groups.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.sources.tables import ntz, read_table

# fixed values: one headline per classifier rule, then two that match none
HEADLINES = (
    "quarterly earnings beat estimates at",
    "profit misses expectations at",
    "earnings call scheduled by",
    "antitrust review opened against",
    "lawsuit filed against",
    "merger talks confirmed by",
    "chief executive to step down at",
    "dividend raised by",
    "stock split planned by",
    "buyback program announced by",
    "new product unveiled by",
    "guidance lowered by",
    "inflation weighs on",
    "insider activity reported at",
    "13f filing shows interest in",
    "analyst downgrade hits",
    "supply chain disruption slows",
    "strong growth and record gain for",
    "weak demand raises concern at",
    "annual picnic held by",
)

# fixed values: (priority digit + status) -> (indicator, divisor)
MACRO_SERIES = (
    ("1O", "vix", 9973.0),
    ("1F", "fed_funds_rate", 59971.0),
    ("1P", "treasury_10y", 64969.0),
    ("2O", "treasury_2y", 64969.0),
    ("2F", "treasury_3m", 65963.0),
    ("2P", "treasury_30y", 61991.0),
    ("3O", "cpi", 997.0),
    ("3F", "unemployment_rate", 59971.0),
    ("3P", "gdp", 9.7),
    ("4O", "core_cpi", 997.0),
    ("4F", "ppi", 997.0),
    ("4P", "real_gdp", 9.7),
    ("5O", "money_supply_m2", 9.7),
    ("5F", "consumer_sentiment", 3989.0),
    ("5P", "industrial_production", 2503.0),
)

NEWS_WINDOW_HOURS = 4320


class Market:
    """The views of one data directory, with its as-of date as a literal."""

    _open: dict[tuple[str, str], "Market"] = {}

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, directory: str) -> "Market":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        key = (spark.sparkContext.applicationId, directory)
        if key not in cls._open:
            cls._open[key] = cls(spark, directory)
        market = cls._open[key]
        market.spark = spark
        return market

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    # Two scalars read once; both are single-row aggregates.
    @cached_property
    def as_of(self) -> dt.datetime:
        day = self.table("lineitem").agg(F.max("l_shipdate")).first()[0]
        return dt.datetime(day.year, day.month, day.day)

    @cached_property
    def n_companies(self) -> int:
        return self.table("supplier").count()

    @property
    def now(self):
        return F.lit(self.as_of)

    def days_ago(self, days: int):
        return F.lit(self.as_of - dt.timedelta(days=days))

    # -- dimensions ---------------------------------------------------------
    def companies(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("company_id"),
                F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
                F.col("s_name").alias("name"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
            )
        )

    # -- bars ---------------------------------------------------------------
    def bars(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Daily bars (company_id, ts) -> open, high, low, close, adjusted_close, volume."""
        trades = self.table("lineitem")
        if since is not None:
            trades = trades.filter(F.col("l_shipdate") >= ntz(since))
        if until is not None:
            trades = trades.filter(F.col("l_shipdate") < ntz(until + dt.timedelta(days=1)))
        price = F.round(100 + 2 * F.log(1 + F.col("l_extendedprice") / F.col("l_quantity")), 4)
        order = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576
                 + F.col("l_partkey") % 1048576)
        trades = trades.select(
            F.col("l_suppkey").alias("company_id"),
            F.to_date("l_shipdate").alias("day"),
            price.alias("price"),
            (price * (1 + F.col("l_tax") - F.col("l_discount"))).alias("quote"),
            order.alias("seq"),
            F.col("l_quantity").alias("qty"),
        )
        daily = trades.groupBy("company_id", "day").agg(
            F.min_by("quote", "seq").alias("open"),
            F.max(F.greatest("price", "quote")).alias("high"),
            F.min(F.least("price", "quote")).alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").cast("long").alias("volume"),
        )
        return daily.select(
            "company_id",
            F.col("day").cast("timestamp").alias("ts"),
            "open", "high", "low", "close",
            F.when(F.dayofmonth("day") % 10 == 0, F.lit(0.0)).otherwise(F.col("close"))
            .alias("adjusted_close"),
            "volume",
        )

    def trade_days(self) -> DataFrame:
        """(company_id, ts) of every trade: enough for recency checks, no aggregation."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").cast("timestamp").alias("ts"))

    def recent_bars(self, days: int) -> DataFrame:
        return self.bars(since=self.as_of - dt.timedelta(days=days))

    # -- statements ---------------------------------------------------------
    def statements(self) -> DataFrame:
        """Quarterly and annual statements; the annual rows reuse the quarterly sums."""
        e, d = F.col("l_extendedprice"), F.col("l_discount")
        day = F.to_date("l_shipdate")
        quarter = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
        measures = {
            "revenue": e * (1 - d),
            "gross_profit": e * (1 - d) - 0.6 * e,
            "operating_income": 0.2 * e * (1 - d),
            "net_income": F.when(F.col("l_returnflag") == "R", -0.4 * e).otherwise(0.2 * e),
            "total_assets": 4 * e,
            "total_liabilities": 2.8 * e,
            "total_debt": F.when(F.col("l_linestatus") == "O", 2.5 * e).otherwise(0.5 * e),
            "cash": 0.3 * e,
            "shareholders_equity": 1.2 * e,
            "operating_cash_flow": 0.35 * e,
            "free_cash_flow": F.when(d >= 0.07, -0.3 * e).otherwise(0.2 * e),
        }
        quarterly = (
            self.table("lineitem")
            .select(F.col("l_suppkey").alias("company_id"), quarter.alias("end"),
                    *[c.alias(n) for n, c in measures.items()])
            .groupBy("company_id", "end")
            .agg(*[F.round(F.sum(n), 4).alias(n) for n in measures])
        )
        annual = (
            quarterly.groupBy(
                "company_id",
                F.make_date(F.year("end"), F.lit(12), F.lit(31)).alias("end"))
            .agg(*[F.round(F.sum(n), 4).alias(n) for n in measures])
        )
        rows = quarterly.withColumn("period_type", F.lit("quarterly")).unionByName(
            annual.withColumn("period_type", F.lit("annual")))
        return rows.select(
            "company_id",
            F.date_format("end", "yyyy-MM-dd").alias("period"),
            "period_type",
            *measures,
            (F.col("free_cash_flow") - F.col("operating_cash_flow")).alias("capital_expenditure"),
            (F.col("net_income") / 1000.0).alias("eps"),
        )

    # -- macro --------------------------------------------------------------
    def macro(self) -> DataFrame:
        """Monthly macro observations (indicator, ts, value)."""
        code = F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
        name, scale = F.lit(None).cast("string"), F.lit(None).cast("double")
        for key, indicator, divisor in MACRO_SERIES:
            name = F.when(code == key, F.lit(indicator)).otherwise(name)
            scale = F.when(code == key, F.lit(divisor)).otherwise(scale)
        return (
            self.table("orders")
            .select(name.alias("indicator"), scale.alias("scale"),
                    F.trunc(F.to_date("o_orderdate"), "month").alias("month"), "o_totalprice")
            .filter(F.col("indicator").isNotNull())
            .groupBy("indicator", "month")
            .agg(F.round(F.avg("o_totalprice") / F.first("scale"), 4).alias("value"))
            .select("indicator", F.col("month").cast("timestamp").alias("ts"), "value")
        )

    # -- text ---------------------------------------------------------------
    def news(self) -> DataFrame:
        docs = self.table("documents")
        phrases = F.array(*[F.lit(p) for p in HEADLINES])
        company = F.col("doc_id") % self.n_companies
        return docs.select(
            F.col("doc_id").alias("news_id"),
            "source",
            F.concat(
                F.element_at(phrases, (F.col("doc_id") % len(HEADLINES) + 1).cast("int")),
                F.lit(" Supplier#"), F.lpad(company.cast("string"), 9, "0"),
            ).alias("title"),
            F.col("text").alias("summary"),
            "lang",
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string")))
            .alias("external_id"),
            F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string")).alias("url"),
            F.when(F.col("lang") == "de", F.lit(0.1)).alias("sentiment"),
            F.timestamp_seconds(
                F.unix_timestamp(self.now) - (F.col("doc_id") % NEWS_WINDOW_HOURS) * 3600
            ).alias("published_at"),
            F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("NASDAQ:S"), company.cast("string")))
            .alias("related"),
        )

    def company_news(self) -> DataFrame:
        """Links: own company (ticker or headline name) plus one weak mention each."""
        docs = self.table("documents").select("doc_id")
        n = self.n_companies
        even = F.col("doc_id") % 2 == 0
        strong = docs.select(
            (F.col("doc_id") % n).alias("company_id"), F.col("doc_id").alias("news_id"),
            F.when(even, F.lit(1.0)).otherwise(F.lit(0.85)).alias("relevance"),
            F.when(even, F.lit("ticker")).otherwise(F.lit("name_match")).alias("method"))
        weak = docs.select(
            ((F.col("doc_id") * 7 + 3) % n).alias("company_id"), F.col("doc_id").alias("news_id"),
            F.lit(0.4).alias("relevance"), F.lit("mention").alias("method"),
        ).filter(F.col("company_id") != F.col("news_id") % n)
        return strong.unionByName(weak)

    # -- vectors ------------------------------------------------------------
    def vectors(self) -> DataFrame:
        """Embedded documents with an entity type and typed metadata."""
        docs = self.table("documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
        kinds = F.array(*[F.lit(k) for k in ("news", "event", "analysis")])
        return (
            self.table("embeddings").join(docs, "vec_id", "left")
            .select(
                F.col("vec_id").alias("id"),
                F.element_at(kinds, (F.col("label") % 3 + 1).cast("int")).alias("entity_type"),
                F.col("vec_id").alias("entity_id"),
                F.coalesce("text", F.lit("")).alias("content"),
                (F.col("vec_id") % self.n_companies).alias("company_id"),
                F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") % 10) / 10.0).alias("importance"),
                F.timestamp_seconds(
                    F.unix_timestamp(self.now) - (F.col("vec_id") % NEWS_WINDOW_HOURS) * 3600
                ).alias("published_at"),
                "source", "label", "embedding",
            )
        )

    # -- scores and analyses (inputs to joins, evaluation and backtests) -----
    def scores(self) -> DataFrame:
        """Quarterly score history, stamped 45 days after the period end."""
        q = self.statements().filter(F.col("period_type") == "quarterly")
        margin = F.try_divide("net_income", "revenue")
        return q.select(
            "company_id",
            F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("period", "yyyy-MM-dd")) + 45 * 86400)
            .alias("ts"),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 60 + 150 * margin)), 4)
            .alias("overall_score"),
            F.round(F.greatest(F.lit(0.0), F.least(
                F.lit(100.0), 100 * F.try_divide("total_debt", "total_assets"))), 4)
            .alias("risk_score"),
        )

    def analyses(self) -> DataFrame:
        """Research analyses built from assistant turns of the conversations."""
        c = self.table("conversations").filter(F.col("role") == "assistant")
        key = F.col("conv_id") * 100 + F.col("turn")
        n_chars = F.length("text")
        return c.select(
            key.alias("analysis_id"),
            (F.col("conv_id") % self.n_companies).alias("company_id"),
            F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") % 5).alias("user_id"),
            F.when(F.col("turn") % 4 == 3, "failed").otherwise("completed").alias("status"),
            F.timestamp_seconds(
                F.unix_timestamp(self.now) - (key * 7 % 400) * F.when(key % 5 == 0, 0).otherwise(86400)
                + (key % 24) * 3600).alias("completed_at"),
            F.when(key % 11 != 0, (n_chars % 101).cast("double")).alias("investment_score"),
            (n_chars % 67).cast("double").alias("risk_score"),
            F.when(key % 13 != 0, (n_chars % 97) / 100.0).alias("llm_confidence"),
            # element_at takes a null index for the last one
            F.when(n_chars.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in ("bullish", "bearish", "neutral", "sideways")]),
                                                     (n_chars % 4 + 1).cast("int"))).alias("direction"),
            (n_chars % 6).cast("int").alias("source_count"),
            "text",
        )
