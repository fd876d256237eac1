"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a task reads or sends to Python at once: texts are long, so batches by the usual thousands hold tens of MB each.
TEXT_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def small_batches(spark: SparkSession) -> SparkSession:
    """Set batch sizes for long texts where the session has none of its own."""
    for key, rows in TEXT_BATCHES.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, rows)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of_four(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of_four(doc_id) == 2, F.lit(False))


def unit(*cols) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def with_running_total(df: DataFrame, group: str, digest: str, order: list[str], value: Column, largest: int,
                       name: str = "before") -> DataFrame:
    """Add the sum of ``value`` over the group's earlier rows, in order of (digest, order).

    ``digest`` is a hex digest, so its leading digits cut every group into even
    ranges. Totals of ranges are summed first (a few rows per range), then each
    range is summed on its own: no task ever holds a whole group. ``largest`` is the
    number of rows of the largest group; a range has about its square root. The
    group column must not be null.
    """
    width = 0
    while largest > max(2_000, math.isqrt(largest)) * 16 ** width:
        width += 1
    cut = df.withColumn("_range", F.substring(digest, 1, width)).withColumn("_value", value)
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (cut.groupBy(group, "_range").agg(F.sum("_value").alias("_sum"))
              .select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(group, "_range").orderBy(digest, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.join(ranges, [group, "_range"])
            .withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .drop("_range", "_value", "_start"))
