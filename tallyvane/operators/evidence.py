"""Claims, their cited sources, and whether the sources support them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import text as tx
from tallyvane.functions.ids import source_id


def register_sources(docs: DataFrame) -> DataFrame:
    """(entity_type, entity_id, content, published_at) -> rows keyed ``<type>_<id>``."""
    return docs.withColumn("source_id", source_id("entity_type", "entity_id"))


def evidence_package(sources: DataFrame) -> DataFrame:
    """Source count and sorted distinct types, one row."""
    return sources.agg(F.count(F.lit(1)).alias("source_count"),
                       F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("source_types"))


def claim_validity(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Per claim: are all cited ids registered (and is there one), and how many resolve?"""
    cited = claims.select("claim_id", F.explode_outer("evidence_ids").alias("source_id"))
    known = sources.select("source_id").distinct().withColumn("_hit", F.lit(1))
    return cited.join(known, "source_id", "left").groupBy("claim_id").agg(
        F.count("source_id").alias("cited"), F.count("_hit").alias("resolved"),
    ).withColumn("valid", (F.col("cited") > 0) & (F.col("cited") == F.col("resolved")))


def supported_evidence(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Keep the cited ids whose content shares enough words with the claim.

    ``claims``: claim_id, claim, evidence_ids. ``sources``: source_id, content.
    The word overlap is taken per (claim, source) pair of an equi-join; only the
    shared claim words travel to the per-claim aggregate, never source text.
    A source cited by a third of all claims is split by the adaptive skew join.
    """
    tok = claims.withColumn("claim_tokens", tx.content_tokens("claim"))
    src = sources.select("source_id", tx.content_tokens("content").alias("source_tokens"))
    pairs = tok.select("claim_id", "claim_tokens", F.posexplode("evidence_ids").alias("pos", "source_id"))
    short_claim = F.size("claim_tokens") < 2
    judged = pairs.join(src, "source_id", "left").select(
        "claim_id", "pos", "source_id", F.size("claim_tokens").alias("n_claim"),
        F.array_intersect("claim_tokens", "source_tokens").alias("shared"),
        F.coalesce(F.size("source_tokens") < 10, F.lit(False)).alias("thin"),
        F.col("source_tokens").isNotNull().alias("known"), short_claim.alias("short"))
    keep = F.col("short") | (F.col("known") & (F.col("thin") | (F.size("shared") >= 2)))
    judged = judged.withColumn("keep", keep)
    words = F.when(F.col("keep") & ~F.col("thin") & F.col("known"), F.col("shared"))
    per_claim = judged.groupBy("claim_id").agg(
        F.first("n_claim").alias("n_claim"), F.bool_or("short").alias("short"),
        F.coalesce(F.bool_or(F.col("keep") & F.col("thin")), F.lit(False)).alias("uncheckable"),
        F.size(F.array_distinct(F.flatten(F.collect_list(words)))).alias("covered"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("pos", "source_id")))),
                    lambda s: s["source_id"]).alias("kept"),
        F.count(F.lit(1)).alias("cited"))
    enough = F.col("covered") >= F.greatest(F.lit(2.0), F.col("n_claim") * 0.5)
    ok = F.col("short") | F.col("uncheckable") | enough
    per_claim = per_claim.withColumn(
        "supported", F.when(ok, F.col("kept")).otherwise(F.array().cast("array<string>")))
    rest = claims.select("claim_id").join(per_claim, "claim_id", "left")
    return rest.select(
        "claim_id", F.coalesce("cited", F.lit(0)).alias("cited"),
        F.coalesce("supported", F.array().cast("array<string>")).alias("supported"))


def drop_unsupported(claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims that keep a citation, warnings for the others)."""
    judged = claims.drop("evidence_ids").join(supported_evidence(claims, sources), "claim_id")
    kept = judged.filter(F.size("supported") > 0).withColumn("evidence_status", F.lit("plausible_support"))
    lost = judged.filter(F.size("supported") == 0).select(
        "claim_id", "claim", F.lit("No cited passage passed the citation support check").alias("reason"))
    return kept, lost


def observations_to_evidence(observations: DataFrame) -> DataFrame:
    """metric / value / period triple of each observation; the whole record when there is no value.

    ``observations``: source, kind, data VARIANT, confidence.
    """
    label = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.nullif(F.col("kind"), F.lit("")), F.lit("observation"))
    return observations.select(
        "*", label.alias("source_name"),
        F.try_variant_get("data", "$.metric", "string").alias("metric"),
        F.coalesce(F.try_variant_get("data", "$.value", "string"), F.to_json("data")).alias("value"),
        F.try_variant_get("data", "$.period", "string").alias("period"))
