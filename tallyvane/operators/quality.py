"""Freshness, source choice, source agreement and completeness of scoring inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.text import source_priority
from tallyvane.functions.times import age_seconds, fresh_enough, freshness_class
from tallyvane.operators.latest import top_per_key
from tallyvane.settings import SETTINGS


def data_age(df: DataFrame, ts: str, as_of) -> DataFrame:
    """Adds age in seconds, freshness class and the daily-fresh flag."""
    age = age_seconds(ts, as_of)
    return df.withColumns({"age_seconds": age, "freshness": freshness_class(age),
                           "is_fresh": age <= dict(SETTINGS.freshness_seconds)["daily"]})


def freshness_gate(df: DataFrame, ts: str, expected: str, as_of) -> DataFrame:
    return df.withColumn("fresh_enough", fresh_enough(age_seconds(ts, as_of), F.col(expected)))


def best_source(rows: DataFrame, keys: list[str], source: str, seq: str) -> DataFrame:
    """Most authoritative row per data point; the first one on equal rank."""
    return top_per_key(rows, keys, [source_priority(source), F.asc(seq)])


def source_agreement(rows: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """How far the sources of a data point agree, and the confidence bonus.

    max |v - avg| is reached at the smallest or largest value, so one partial
    aggregate gives it without a second pass.
    """
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_count"), F.avg(value).alias("_avg"),
        F.min(value).alias("_min"), F.max(value).alias("_max"))
    worst = F.greatest(F.col("_max") - F.col("_avg"), F.col("_avg") - F.col("_min"))
    raw = F.when(F.col("source_count") == 1, 1.0).when(F.col("_avg") == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - worst / F.abs("_avg")))
    snapped = F.when(raw > 1 - tolerance, 1.0).otherwise(raw)
    bonus = (F.col("source_count") - 1) * 0.05 * snapped
    return g.select(*keys, "source_count", F.bround(snapped, 4).alias("agreement"),
                    F.bround(bonus, 4).alias("confidence_adjustment"))


def provenance(source, source_id, published_at, retrieved_at, version: str = "1.0") -> Column:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.struct(F.col(source).alias("source"), F.col(source_id).alias("source_id"),
                    iso(F.col(published_at)).alias("published_at"), iso(retrieved_at).alias("retrieved_at"),
                    F.lit(version).alias("data_version"))


def recency(rows: DataFrame, ts: str, days: int, as_of, name: str) -> DataFrame:
    """Per company 1.0 when there is data in the window, 0.5 when only older data."""
    since = F.timestamp_seconds(F.unix_timestamp(as_of) - days * 86400)
    return rows.groupBy("company_id").agg(
        F.when(F.max(ts) >= since, 1.0).otherwise(0.5).alias(name))


def assess(companies: DataFrame, parts: dict[str, DataFrame], financial: DataFrame,
           weights=SETTINGS.quality) -> DataFrame:
    """Weighted quality per company; a dataset without rows counts 0.

    ``parts``: name -> (company_id, name) for price, technical, news and events;
    ``financial``: company_id, financial_quality, fallback_components.
    """
    out = companies.select("company_id")
    for name, df in parts.items():
        out = out.join(df, "company_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    out = out.join(financial.select("company_id", "financial_quality", "fallback_components"), "company_id", "left")
    out = out.withColumn("fundamental", F.coalesce("financial_quality", F.lit(0.0))).drop("financial_quality")
    pairs = (("price", weights.price), ("technical", weights.technical), ("news", weights.news),
             ("events", weights.events), ("fundamental", weights.fundamental))
    total = sum(w for _, w in pairs)
    overall = sum((F.col(n) * w for n, w in pairs), F.lit(0.0)) / total
    return out.withColumn("quality", F.bround(overall, 4)).withColumn(
        "sufficient", overall >= SETTINGS.min_quality)
