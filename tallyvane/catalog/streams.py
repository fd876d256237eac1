"""Quotas and stream forms over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import sql_time, time_text
from tallyvane.catalog.registry import query
from tallyvane.streaming import drain as dr
from tallyvane.streaming import ingest, limits, reactions

DAY = 86400


def log(m):
    return m.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("over_quota", "L2", f"""
    SELECT event_id, user_id, n AS in_window, n > 3 AS over,
           CASE WHEN n > 3 THEN greatest(1, CAST(ceil(({DAY}000000 - date_diff('microsecond', oldest, ts)) / 1000000) AS BIGINT)) END AS retry_after
    FROM (SELECT *, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))""")
def over_quota(m):
    return limits.over_quota(log(m), "user_id", "ts", 3, DAY).select("event_id", "user_id", "in_window", "over", "retry_after")


@query("fixed_window_attempts", "L3", f"""
    SELECT user_id, {sql_time("time_bucket(INTERVAL 1 HOUR, ts)", "window_start")}, count(*) AS attempts FROM events GROUP BY ALL""")
def fixed_window_attempts(m):
    return limits.fixed_windows(log(m), "user_id", "ts", 3600).select("user_id", time_text("window_start"), "attempts")


@query("streamed_windows", "L3 L1", f"""
    SELECT user_id, {sql_time("time_bucket(INTERVAL 1 HOUR, ts)", "window_start")}, count(*) AS attempts FROM events GROUP BY ALL""")
def streamed_windows(m):
    """The same counters from the stream: counts per batch, summed on reading."""
    path = dr.shared_folder(m.spark) + "/counts"
    dr.drain_batches(dr.event_stream(m.spark, m.directory), limits.count_batch(path, "user_id", "ts", 3600))
    stored = m.spark.read.parquet(path)
    return limits.counted(stored, "user_id").select("user_id", time_text("window_start"), "attempts")


@query("streamed_ingest", "L1", "SELECT event_id, user_id, event_type, value FROM events")
def streamed_ingest(m):
    """Every event arrives twice; append-if-absent per batch stores it once, however late it is."""
    s = dr.event_stream(m.spark, m.directory).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    path = dr.shared_folder(m.spark) + "/events"
    dr.drain_batches(s, ingest.append_batch(path, ["event_id"]))
    return m.spark.read.parquet(path).select("event_id", "user_id", "event_type", "value")


@query("streamed_reactions", "L4", """
    SELECT c.user_id, c.event_id AS cause_id, e.event_id AS effect_id FROM events c JOIN events e ON c.user_id = e.user_id
    WHERE c.event_type = 'view' AND e.event_type = 'purchase' AND e.ts >= c.ts AND e.ts <= c.ts + INTERVAL 6 HOUR""")
def streamed_reactions(m):
    s = lambda kind: dr.event_stream(m.spark, m.directory).filter(F.col("event_type") == kind)
    out = reactions.reactions(s("view"), s("purchase"), "user_id", 6 * 3600)
    return dr.drain(out).select("user_id", "cause_id", "effect_id")


@query("streamed_alerts", "L5 J12", """
    SELECT user_id % (SELECT count(*) FROM supplier) AS company_id, event_id AS source_id, CASE WHEN value >= 80 THEN 'high' ELSE 'medium' END AS severity
    FROM (SELECT * FROM events WHERE event_type = 'error' AND value >= 10)""")
def streamed_alerts(m):
    """Error events as triggered anomalies; each one alerts, replays add none."""
    s = dr.event_stream(m.spark, m.directory).filter("event_type = 'error'").select(
        (F.col("user_id") % m.n_companies).alias("company_id"), F.col("event_id").alias("anomaly_id"),
        F.col("value").alias("overall_score"), (F.col("value") >= 10).alias("triggered"), "ts")
    path = dr.shared_folder(m.spark) + "/alerts"
    handle = ingest.alert_batch(m.companies(), path)

    def twice(batch, epoch):
        handle(batch, epoch)
        handle(batch, epoch)

    dr.drain_batches(s, twice)
    return m.spark.read.parquet(path).select("company_id", "source_id", "severity")
