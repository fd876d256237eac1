"""Latest-row and top-k selection per key.

``row_number() <= k`` / ``rank() = 1`` filters become a WindowGroupLimit in the
physical plan: every map task keeps at most k rows per key before the shuffle,
so a key with a third of all rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int = 1,
                rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of each key under ``order`` (a total order)."""
    rn = rank_col or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, *tie: str) -> DataFrame:
    """One row per key: newest ``ts``, ties broken by the larger ``tie`` columns."""
    return top_per_key(df, keys, [F.desc(c) for c in (ts, *tie)], 1)


def latest_with_ties(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows that share each key's newest timestamp (group-max self join)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Ordered dedup: the row with the smallest ``seq`` of each key."""
    return top_per_key(df, keys, [F.asc(seq)], 1)
