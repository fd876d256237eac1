"""Scores and analyses against what prices did afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.pricing import forward_returns


def evaluate_scores(scores: DataFrame, bars: DataFrame) -> DataFrame:
    """Forward returns of each score and the label of the three-month one (5 % either way)."""
    out = forward_returns(scores.filter("overall_score IS NOT NULL"), bars, "ts")
    r = F.col("return_3m")
    return out.withColumn("actual_outcome", F.when(r > 0.05, "POSITIVE").when(r < -0.05, "NEGATIVE")
                          .when(r.isNotNull(), "NEUTRAL"))


def stated_direction(interpretation: str):
    """Direction of a VARIANT interpretation: its field when an object, words when text."""
    v = F.col(interpretation)
    is_text = F.startswith(F.schema_of_variant(v), F.lit("STRING"))
    text = F.lower(F.try_variant_get(v, "$", "string"))
    field = F.try_variant_get(v, "$.direction", "string")
    return (F.when(is_text, F.when(F.contains(text, F.lit("bull")), "bullish")
                   .when(F.contains(text, F.lit("bear")), "bearish").otherwise("neutral"))
            .when(field.isin("bullish", "bearish", "neutral"), field))


def evaluate_analyses(analyses: DataFrame, bars: DataFrame) -> DataFrame:
    """Stated direction against the move of the next three months (2 % either way).

    ``analyses``: analysis_id, company_id, status, created_at, llm_direction,
    llm_confidence, evidence_count.
    """
    done = analyses.filter("status = 'completed'")
    out = forward_returns(done, bars, "created_at", horizons=(("3m", 91),)).withColumnRenamed("return_3m", "forward_return")
    r = F.col("forward_return")
    out = out.withColumn("actual_direction", F.when(r > 0.02, "up").when(r < -0.02, "down").when(r.isNotNull(), "flat"))
    said = (F.when(F.col("llm_direction") == "bullish", "up").when(F.col("llm_direction") == "bearish", "down")
            .when(F.col("llm_direction").isNotNull(), "flat"))
    return out.withColumn("direction_accuracy", F.when(
        F.col("actual_direction").isNotNull() & said.isNotNull(), said == F.col("actual_direction"))).withColumn(
        "source_backed", F.coalesce("evidence_count", F.lit(0)) > 0)
