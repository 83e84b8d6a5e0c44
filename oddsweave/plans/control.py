"""Queries of the control plane over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsweave.operators import control, reports
from oddsweave.plans.catalog import query
from oddsweave.sources.tables import table, with_views

STREAM = with_views("stream")


@query(STREAM + " SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 5 AS allowed, CAST(5 * least(count(*) OVER w, 6) AS BIGINT) AS cooldown_s FROM stream WHERE event_type = 'error' WINDOW w AS (PARTITION BY lane ORDER BY epoch_us(ts) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW)")
def w12_restart_budget(spark, d):
    errors = table(spark, d, "stream").filter("event_type = 'error'")
    return control.restart_budget(errors, "lane", "ts").select("event_id", "in_window", "allowed", "cooldown_s")


@query("SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS lane FROM events WHERE event_id % 5 <> 0 AND event_type <> 'error'")
def r01_event_lines(spark, d):
    """Events written as prefixed lines among others, and read back."""
    body = F.to_json(F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("type"), F.col("user_id").cast("string").alias("lane"), F.col("event_id").alias("pid")))
    lines = table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 5 == 0, "plain output ").otherwise(control.PREFIX), body).alias("value"))
    return control.parse_lines(lines).select(F.col("pid").alias("event_id"), "type", "lane")


@query(STREAM + " SELECT lane, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n_events FROM stream GROUP BY 1")
def r02_lane_state(spark, d):
    return control.lane_state(table(spark, d, "stream"), "lane", "ts", "event_id").select("lane", F.unix_micros("last_at").alias("last_us"), "last_type", "n_events")


@query(STREAM + ", g AS (SELECT lane, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY lane ORDER BY ts, event_id)) / 1e6 AS gap FROM stream) SELECT lane, count(*) FILTER (gap > 3600) AS n_stale, round(max(gap), 6) AS longest_gap FROM g GROUP BY 1")
def r03_stale_heartbeats(spark, d):
    return control.stale_gaps(table(spark, d, "stream"), "lane", "ts", "event_id", 3600).withColumn("longest_gap", F.round("longest_gap", 6))


@query("WITH e AS (SELECT event_id, event_id * 997 // 1 AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM e")
def r08_duration_text(spark, d):
    return table(spark, d, "events").select("event_id", reports.duration_text(F.col("event_id") * 997 * 1000).alias("duration"))


@query(STREAM + " SELECT CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS date_key, count(*) AS n_events FROM stream GROUP BY 1")
def f03_civil_dates(spark, d):
    from oddsweave.functions.rules import civil_date

    return table(spark, d, "stream").groupBy(civil_date(F.col("ts")).cast("string").alias("date_key")).agg(F.count(F.lit(1)).alias("n_events"))
