"""Identifier resolution and news-to-company linking as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.ids import normalize_company_name, normalize_ticker, pad_cik
from tallyvane.operators.latest import top_per_key

_WORD = r"[\p{L}\p{N}_]+"


def _keys(df: DataFrame, row_id: str, raw: bool) -> DataFrame:
    ticker = normalize_ticker("ticker") if raw else F.col("ticker")
    parts = [("ticker", ticker), ("cik", pad_cik("cik")), ("isin", F.upper("isin")), ("cusip", F.upper("cusip"))]
    entries = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(k).alias("kind"), v.alias("value"))
                        for i, (k, v) in enumerate(parts)])
    return (df.select(row_id, F.explode(entries).alias("e"))
            .select(row_id, "e.*").filter(F.coalesce("value", F.lit("")) != ""))


def resolve_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Match on ticker, else CIK, ISIN or CUSIP: (kind, value) equi-join, no OR condition.

    ``requests``: request_id, ticker, cik, isin, cusip. Unmatched requests keep NULL.
    """
    wanted = _keys(requests, "request_id", raw=True)
    known = _keys(companies, "company_id", raw=False).drop("prio")
    hits = wanted.join(known, ["kind", "value"])
    best = top_per_key(hits, ["request_id"], [F.asc("company_id"), F.asc("prio")])
    return requests.join(best.select("request_id", "company_id", F.col("kind").alias("matched_on")),
                         "request_id", "left")


def cik_lookup(tickers: DataFrame, index: DataFrame) -> DataFrame:
    """ticker -> zero-padded CIK through the published index, case-insensitive."""
    idx = index.select(F.upper("ticker").alias("_t"), pad_cik("cik_str").alias("cik"))
    return tickers.join(idx, F.upper(tickers["ticker"]) == F.col("_t"), "left").drop("_t")


def link_news(news: DataFrame, companies: DataFrame) -> DataFrame:
    """(news_id, company_id, relevance, method), one link per pair.

    Tickers match first (1.0). Names match whole words of the title only (0.85).
    The name rule is an equi-join: every run of up to L title words is compared
    with the word form of the names, where L is the longest name's word count;
    the few candidates are then checked with the exact word-boundary pattern.
    ``news``: news_id, title, tickers ARRAY<STRING>.
    """
    by_ticker = (
        news.select("news_id", F.explode("tickers").alias("t"))
        .select("news_id", normalize_ticker("t").alias("ticker")).filter("ticker <> ''")
        .join(companies.select("company_id", "ticker"), "ticker")
        .select("news_id", "company_id", F.lit(1.0).alias("relevance"), F.lit("ticker").alias("method"),
                F.lit(0).alias("prio"))
    )
    names = companies.select("company_id", normalize_company_name("name").alias("_name")).filter(
        F.length("_name") > 2).withColumn("_words", F.regexp_extract_all("_name", F.lit(f"({_WORD})")))
    names = names.withColumn("gram", F.array_join("_words", " ")).withColumn("_len", F.size("_words"))
    # distinct name lengths: a handful of values, at most one row per word count
    lengths = names.select(F.col("_len").alias("n")).distinct()
    words = news.select("news_id", "title", F.regexp_extract_all(F.lower("title"), F.lit(f"({_WORD})")).alias("w"))
    all_lengths = lengths.agg(F.collect_set("n").alias("ns")).scalar()
    grams = (
        words.withColumn("n", F.explode(all_lengths))
        .filter(F.col("n").between(1, F.size("w")))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
        .select("news_id", "title", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("gram"))
        .distinct()
    )
    by_name = (
        grams.join(names, "gram")
        .filter(F.regexp("title", F.concat(F.lit(r"(?iu)\b\Q"), "_name", F.lit(r"\E\b"))))
        .select("news_id", "company_id", F.lit(0.85).alias("relevance"), F.lit("name_match").alias("method"),
                F.lit(1).alias("prio"))
    )
    return top_per_key(by_ticker.unionByName(by_name), ["news_id", "company_id"], [F.asc("prio")]).drop("prio")


def relationship(source_domain, source_type, target_domain, target_type):
    """cross_domain, same_type or related."""
    return (F.when(F.col(source_domain) != F.col(target_domain), "cross_domain")
            .when(F.col(source_type) == F.col(target_type), "same_type").otherwise("related"))


def link_counts(pairs: DataFrame) -> DataFrame:
    """Bucket sizes of (source_id, source/target domain and type) candidate pairs."""
    rel = relationship("source_domain", "source_type", "target_domain", "target_type")
    return (pairs.withColumn("relationship", rel)
            .groupBy("source_id", "relationship").agg(F.count(F.lit(1)).alias("targets")))
