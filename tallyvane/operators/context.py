"""Research context of every company from one tagged union of section rows.

Each source becomes rows (company_id, section, ts, row_id, payload) with the payload as
VARIANT, so sources of any shape share one plan: the newest row of a section (ten for
news and events) is a group limit that Spark also applies on the map side, and one
aggregate by company turns sections into columns. No source is joined with another; the counts
of all items travel through the same aggregate as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.latest import top_per_key

#: section -> rows kept per company
SECTIONS = {"market": 1, "technical": 1, "metrics": 1, "statement": 1, "news": 10, "event": 10, "risk": 1, "anomaly": 1}
REQUIRED = ("market", "technical", "fundamental", "risk")


def _finite(df: DataFrame) -> Column:
    """Whether any number of the row is there and finite."""
    usable = F.lit(False)
    for name, kind in df.dtypes:
        if name != "company_id" and kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
            value = F.col(name).cast("double")
            usable = usable | F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
    return usable


def section_rows(rows: DataFrame, section: str, ts: str | None = None, row_id: str | None = None) -> DataFrame:
    """Rows of a source under a section's tag; without a time all rows are equally new and the id settles it."""
    fields = [c for c in rows.columns if c != "company_id"]
    return rows.select(
        "company_id", F.lit(section).alias("section"), (F.col(ts) if ts else F.lit(None)).cast("timestamp").alias("ts"),
        (F.col(row_id) if row_id else F.lit(0)).cast("long").alias("row_id"), _finite(rows).alias("usable"),
        F.to_variant_object(F.struct(*fields)).alias("payload"))


def assemble(companies: DataFrame, parts: list[DataFrame], macro: DataFrame | None = None) -> DataFrame:
    """One row per company: ``<section>_snapshot`` columns, ``news_count``, ``event_count`` and ``missing_snapshots``.

    ``parts``: results of ``section_rows``. The fundamental section holds metrics and latest statement, and is missing unless one of them
    has a finite number. ``macro`` (indicator, ts, value) is the same map for all companies, its latest values: one row per indicator of
    the catalogue, read as a scalar. Sections without rows are null.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    wide = F.lit(0)
    for section, n in SECTIONS.items():
        wide = F.when(F.col("section") == section, n).otherwise(wide)
    newest = top_per_key(rows, ["company_id", "section"], [F.desc_nulls_last("ts"), F.desc("row_id")], max(SECTIONS.values()), rank_col="_rk")
    newest = newest.filter(F.col("_rk") <= wide).select("company_id", "section", "_rk", "usable", "payload", F.lit(0).cast("long").alias("n"))
    counts = rows.filter(F.col("section").isin("news", "event")).groupBy("company_id", "section").agg(F.count(F.lit(1)).alias("n"))
    tagged = newest.unionByName(counts.select("company_id", "section", F.lit(0).alias("_rk"), F.lit(False).alias("usable"),
                                              F.lit(None).cast("variant").alias("payload"), "n"))
    one = lambda s: F.any_value(F.when((F.col("section") == s) & (F.col("_rk") == 1), F.col("payload")), ignoreNulls=True)
    # ordered by rank; a variant has no order of its own, so it is kept beside the rank in a map
    many = lambda s: F.map_from_entries(F.collect_list(F.when((F.col("section") == s) & (F.col("_rk") > 0), F.struct("_rk", "payload"))))
    total = lambda s: F.sum(F.when(F.col("section") == s, F.col("n")))
    singles = [s for s, n in SECTIONS.items() if n == 1]
    lists = [s for s, n in SECTIONS.items() if n > 1]
    by_company = tagged.groupBy("company_id").agg(
        *[one(s).alias(f"_{s}") for s in singles], *[many(s).alias(f"_{s}") for s in lists], *[total(s).alias(f"{s}_count") for s in lists],
        F.max(F.when(F.col("section").isin("metrics", "statement") & (F.col("_rk") == 1), F.col("usable"))).alias("_usable"))
    ordered = lambda s: F.transform(F.sort_array(F.map_keys(f"_{s}")), lambda k: F.element_at(f"_{s}", k))
    both = F.struct(F.col("_metrics").alias("metrics"), F.col("_statement").alias("latest_statement"))
    out = companies.join(by_company, "company_id", "left").withColumn(
        "fundamental_snapshot", F.when(F.col("_metrics").isNotNull() | F.col("_statement").isNotNull(), both))
    for s in ("market", "technical", "risk", "anomaly"):
        out = out.withColumn(f"{s}_snapshot", F.col(f"_{s}"))
    for s in lists:
        out = out.withColumn(f"{s}_snapshot", F.when(F.size(f"_{s}") > 0, ordered(s))).withColumn(
            f"{s}_count", F.coalesce(f"{s}_count", F.lit(0)))
    if macro is not None:
        latest = macro.filter("value IS NOT NULL").groupBy("indicator").agg(F.max_by("value", "ts").alias("value"))
        indicators = latest.agg(F.map_from_entries(F.collect_list(F.struct("indicator", "value"))).alias("m")).scalar()
        out = out.withColumn("macro_snapshot", F.when(F.size(indicators) > 0, indicators))
    gone = {s: F.col(f"{s}_snapshot").isNull() for s in REQUIRED}
    gone["fundamental"] = gone["fundamental"] | ~F.coalesce("_usable", F.lit(False))
    missing = F.array_compact(F.array(*[F.when(gone[s], F.lit(f"{s}_snapshot")) for s in REQUIRED]))
    return out.withColumn("missing_snapshots", missing).drop("_usable", *[f"_{s}" for s in SECTIONS])
