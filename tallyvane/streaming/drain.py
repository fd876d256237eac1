"""Run a stream over what is there now and read back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyvane.operators import materialize

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def table_stream(spark: SparkSession, directory: str, name: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A table as a file stream; ``<name>*.parquet`` are files or folders of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{directory}/{name}*.parquet")


def event_stream(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """The event log as a file stream with event time as TIMESTAMP."""
    raw = table_stream(spark, directory, "events", EVENT_SCHEMA, files_per_trigger)
    return raw.withColumn("ts", raw["ts"].cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder."""
    return f"{materialize.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write everything available to parquet and return it as a batch."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, handle) -> None:
    """Feed everything available to ``handle(batch, epoch)``."""
    folder = shared_folder(stream.sparkSession)
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
