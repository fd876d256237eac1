"""Sinks: raw landing, append-if-absent, and idempotent partition overwrite.

Targets are partitioned parquet directories on shared storage. Each write is one
Spark job; a rerun after a lost executor or a retried job adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyvane.operators.upsert import new_rows


def land_raw(payloads: DataFrame, path: str, provider: str, endpoint: str, retrieved_at) -> None:
    """Append raw payload text with its provenance, partitioned by provider and day."""
    (payloads.select(
        F.lit(provider).alias("provider"), F.lit(endpoint).alias("endpoint"),
        F.lit(retrieved_at).alias("retrieved_at"),
        F.lit(retrieved_at).cast("date").alias("day"), "payload")
     .write.mode("append").partitionBy("provider", "day").parquet(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists; a store that cannot be reached is an error, not an empty table."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()).exists(place)


def append_new(incoming: DataFrame, path: str, keys: list[str], seq: str,
               partition_by: list[str] | None = None) -> dict[str, int]:
    """Append rows whose key is not stored yet; returns inserted and seen counts.

    Counts come from ``observe`` on the write itself, so no second pass is made. A partition
    column that is one of the keys prunes the stored side to the values that come in.
    """
    spark = incoming.sparkSession
    if exists(spark, path):
        target = spark.read.schema(incoming.schema).parquet(path)
        for column in set(partition_by or []) & set(keys):
            target = target.join(incoming.select(column).distinct(), column, "left_semi")
    else:
        target = spark.createDataFrame([], incoming.schema)
    seen, added = Observation("seen"), Observation("added")
    incoming = incoming.observe(seen, F.count(F.lit(1)).alias("n"))
    fresh = new_rows(incoming, target, keys, seq).observe(added, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
    return {"seen": seen.get["n"], "inserted": added.get["n"]}


def overwrite_day(df: DataFrame, path: str, day_column: str) -> None:
    """Replace only the days present in ``df`` (one snapshot per day, safe to rerun)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day_column).parquet(path))
