"""Readers for the driver tables (one parquet per table, explicit columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def ntz(moment):
    """Literal comparable to the files' zone-less timestamps, so it reaches the scan."""
    return F.lit(moment).cast("timestamp_ntz")
