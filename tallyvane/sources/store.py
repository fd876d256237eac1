"""Tables that change together: a commit over several tables, seen whole or not at all.

A commit writes each table's rows under ``<root>/<table>/commit=<name>`` and then one
manifest row under ``<root>/_commits/commit=<name>``. Readers join the tables with the
manifests on the partition column, so rows of a commit whose driver died before the
manifest are never read; a rerun under the same name replaces them. A name that has a
manifest is done: writing it again computes nothing and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyvane.sources.writers import exists

_MANIFEST = "job string, row_counts map<string, bigint>"


class Store:
    """``schemas``: the columns of each table as a DDL string; the commit's name is an extra column of every read.

    ``partitions``: columns that cut a table's commits into folders, so that reads by them are pruned.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], partitions: dict[str, list[str]] | None = None):
        self.spark, self.root, self.schemas, self.partitions = spark, root.rstrip("/"), schemas, partitions or {}

    def _empty(self, ddl: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{ddl}, commit string")

    def manifests(self) -> DataFrame:
        """(job, row_counts, commit) of every finished commit."""
        path = f"{self.root}/_commits"
        if not exists(self.spark, path):
            return self._empty(_MANIFEST)
        return self.spark.read.schema(f"{_MANIFEST}, commit string").parquet(path)

    def is_done(self, name: str) -> bool:
        return bool(self.manifests().where(F.col("commit") == name).limit(1).count())

    def read(self, table: str) -> DataFrame:
        """Rows of finished commits; others are pruned by partition."""
        path = f"{self.root}/{table}"
        if not exists(self.spark, path):
            return self._empty(self.schemas[table])
        rows = self.spark.read.schema(f"{self.schemas[table]}, commit string").parquet(path)
        return rows.join(self.manifests().select("commit"), "commit", "left_semi").select(*rows.columns)

    def latest(self, table: str, keys: list[str]) -> DataFrame:
        """The row of the newest commit for each key; commits are ordered by name."""
        rows = self.read(table)
        newest = rows.groupBy(*keys).agg(F.max("commit").alias("commit"))
        return rows.join(newest, [*keys, "commit"], "left_semi").select(*rows.columns)

    def next_name(self, prefix: str) -> str:
        """A name that sorts behind all finished commits of the store (one writer at a time)."""
        return f"{prefix}-{self.manifests().count() + 1:012d}"

    def commit(self, name: str, job: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, int]:
        """Write what ``build`` returns unless the name is done; returns rows written per table.

        ``build`` is only called when there is work to do. Names sort in the order of their commits if ``latest`` is used.
        """
        if self.is_done(name):
            return {}
        counts = {}
        for table, rows in build().items():
            seen = Observation()
            columns = self._empty(self.schemas[table]).columns[:-1]
            rows.select(*columns).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(
                *self.partitions.get(table, [])).parquet(f"{self.root}/{table}/commit={name}")
            counts[table] = seen.get["n"]
        told = F.create_map(*[x for t, n in counts.items() for x in (F.lit(t), F.lit(n).cast("bigint"))])
        # one row in one file: the commit point
        (self.spark.range(1, numPartitions=1).select(F.lit(job).alias("job"), told.alias("row_counts"))
         .write.mode("overwrite").parquet(f"{self.root}/_commits/commit={name}"))
        return counts
