"""Corpus pipeline: five stages from raw documents to shards, each one operator of ``tallyvane.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last one adds the shard and its slot. ``run`` writes each
stage's result to the shared folder and rereads it, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import decontaminate, language_id, near_dedup, sharding, source_mix
from tallyvane.llm.common import WORD, small_batches, table
from tallyvane.operators.materialize import stored
from tallyvane.session import ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no learned language fits better than by chance, like those without a letter.

    Profiles are learned from the stage's labelled documents.
    """
    small_batches(ship_package(spark))
    profiles = language_id.fit_profiles(docs.select("text", "lang", F.col("doc_id").alias("sample_key")))
    return language_id.keep_identified(docs, profiles, min_score=profiles.chance)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 over five-word shingles."""
    small_batches(ship_package(spark))
    return near_dedup.drop_near_duplicates(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    small_batches(ship_package(spark))
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to weights 1, 2, 3: a document comes as often as the mix takes it, 0 to 3 times."""
    small_batches(spark)
    sizes = docs.select("*", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("_size"))
    keyed = stored(sizes.select(
        "doc_id", F.col("_size").alias("size"), F.array("source").alias("sources"), F.xxhash64("text").alias("_text")), "mix-sizes")
    taken = source_mix.mix(keyed).where("repeats > 0").groupBy("doc_id", "_text", "sources").agg(
        F.sort_array(F.collect_list("repeats")).alias("repeats"))
    return _repeat(docs, taken)


def _repeat(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of ``docs`` repeated; equal rows are interchangeable and share out their repeats."""
    plan = taken.select(F.col("doc_id").alias("_id"), "_text", F.col("sources")[0].alias("_source"),
                        F.aggregate("repeats", F.lit(0), lambda a, x: a + x).alias("_times"), F.size("repeats").alias("_rows"))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    same = (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")) & F.col("source").eqNullSafe(F.col("_source")))
    met = keyed.join(plan, same)
    one = met.where("_rows = 1")
    several = met.where("_rows > 1").dropDuplicates(["doc_id", "_hash", "source"])
    both = one.unionByName(several).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return both.select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document row's place: doc_id, size, text_crc32, shard, slot."""
    return sharding.shard_documents(docs, 40)


STAGES = [("language", known_language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
          ("mix", mixed), ("shards", sharded)]

#: SQL has no hyperdimensional profiles, LSH forests or random-walk embeddings; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard rows of all documents that pass every stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
