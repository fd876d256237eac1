"""First-write-wins inserts, duplicate collapse and merges as joins.

All forms reduce the incoming side to one row per key before any join, so a
group of copies never travels further than its map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.latest import keep_first, top_per_key


def new_rows(incoming: DataFrame, target: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows an ``ON CONFLICT DO NOTHING`` insert would add (first ``seq`` per key wins)."""
    return keep_first(incoming, keys, seq).join(target.select(*keys), keys, "left_anti")


def insert_counts(incoming: DataFrame, added: DataFrame, by: list[str]) -> DataFrame:
    """inserted / skipped per group."""
    seen = incoming.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"))
    ins = added.groupBy(*by).agg(F.count(F.lit(1)).alias("ins"))
    return seen.join(ins, by, "left").select(
        *by, F.coalesce("ins", F.lit(0)).alias("inserted"),
        (F.col("seen") - F.coalesce("ins", F.lit(0))).alias("skipped"))


def news_identity() -> Column:
    """Effective unique key of an article.

    The hash of a row with a provider id already contains (source, id), so the
    two unique constraints collapse to one key: the id when present, else the hash.
    """
    has_id = F.coalesce("external_id", F.lit("")) != ""
    return F.when(has_id, F.concat_ws("|", F.lit("id"), "source", "external_id")).otherwise(
        F.concat_ws("|", F.lit("hash"), "content_hash"))


def new_news(incoming: DataFrame, stored: DataFrame, seq: str) -> DataFrame:
    """Articles that are neither stored under their id nor under their hash."""
    first = keep_first(incoming.withColumn("_key", news_identity()), ["_key"], seq)
    known_ids = stored.filter(F.coalesce("external_id", F.lit("")) != "").select("source", "external_id")
    return (first.join(stored.select("content_hash"), "content_hash", "left_anti")
            .join(known_ids, ["source", "external_id"], "left_anti").drop("_key"))


def surviving_news(incoming: DataFrame, stored: DataFrame, seq: str) -> DataFrame:
    """For every incoming article the id of the stored row it maps to (id match first, then hash)."""
    ids = keep_first(stored.filter(F.coalesce("external_id", F.lit("")) != ""),
                     ["source", "external_id"], "news_id").select(
        "source", "external_id", F.col("news_id").alias("by_id"))
    hashes = keep_first(stored, ["content_hash"], "news_id").select(
        "content_hash", F.col("news_id").alias("by_hash"))
    return (incoming.join(ids, ["source", "external_id"], "left")
            .join(hashes, "content_hash", "left")
            .withColumn("survivor", F.coalesce("by_id", "by_hash")).drop("by_id", "by_hash"))


def collapse_duplicates(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Keep the highest id per key; NULL keys form one group."""
    return top_per_key(df, keys, [F.desc(row_id)])


def merge_keep_old(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Upsert where a NULL in the new row keeps the stored value."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    return old.join(n, keys, "full").select(
        *keys, *[F.coalesce(f"_n_{c}", c).alias(c) for c in cols])


def mark_existing(probe: DataFrame, target: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Probe rows with a boolean: does the target hold their key?"""
    known = target.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return probe.join(known, keys, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def fill_missing(existing: DataFrame, incoming: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Resolve-or-create: stored values win, gaps are filled, unknown keys are added."""
    inc = incoming.select(key, *[F.col(c).alias(f"_i_{c}") for c in cols])
    return existing.join(inc, key, "full").select(
        key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_i_{c}")).alias(c) for c in cols])


def overlay_profile(existing: DataFrame, incoming: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Profile merge: a non-empty incoming value wins, else the stored one stays."""
    inc = incoming.select(key, *[F.col(c).alias(f"_i_{c}") for c in cols])
    return existing.join(inc, key, "left").select(
        key, *[F.coalesce(F.nullif(F.col(f"_i_{c}"), F.lit("")), F.col(c)).alias(c) for c in cols])


def not_yet_embedded(items: DataFrame, vectors: DataFrame, entity_type: str) -> DataFrame:
    """Items of one type without a stored vector."""
    done = vectors.filter(F.col("entity_type") == entity_type).select(
        F.col("entity_id").alias("item_id"))
    return items.join(done, "item_id", "left_anti")


def split_vectors(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(storable, rejected with reason): blank text, empty vector, wrong dimension."""
    reason = (F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "blank content")
              .when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "empty vector")
              .when(F.size("embedding") != dim, "wrong dimension"))
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
