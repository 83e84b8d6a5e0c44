"""Structured Streaming forms of the control plane and of the consensus sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsweave.operators import consensus, control


def worker_events(lines: DataFrame) -> DataFrame:
    """Worker events from a stream (or table) of output lines."""
    return control.parse_lines(lines)


def lane_silences(events: DataFrame, late: str = "10 minutes", gap: str = "90 seconds") -> DataFrame:
    """Sessions of heartbeats per lane: a session ends when a lane is silent for longer than ``gap``.

    State holds open sessions only; the watermark closes them.
    """
    return (
        events.withWatermark("at", late)
        .groupBy("lane", F.session_window("at", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max("cycle").alias("last_cycle"))
        .select("lane", F.col("session.start").alias("first_at"), F.col("session.end").alias("silent_from"), "n_events", "last_cycle")
    )


def restarts_per_window(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Restarts per lane in sliding windows of the budget's length."""
    window = F.window("at", f"{control.RESTART_MINUTES} minutes", "5 minutes")
    return events.filter("type = 'restart'").withWatermark("at", late).groupBy("lane", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("lane", F.col("w.end").alias("until"), "n", (F.col("n") <= control.RESTARTS).alias("allowed"))


def latest_prices(prices: DataFrame, ts: str = "updated_at", late: str = "2 hours", keys: tuple[str, ...] = ("fixture_id", "bookmaker", "pa_category", "selection")) -> DataFrame:
    """Repeated deliveries of a price once; state is bounded by the watermark, like the prices' time to live."""
    return prices.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, "price"])


def sweep_batch(read_prices, read_upcoming, write):
    """A ``foreachBatch`` function: judges the fixtures that a micro-batch touched by all their current prices.

    ``read_prices`` and ``read_upcoming`` give the current tables, ``write``
    takes the mismatches and the batch id (and must be idempotent in it).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("fixture_id").distinct()
        due = touched.join(read_upcoming().select("fixture_id").distinct(), "fixture_id", "left_semi")
        write(consensus.mismatches(read_prices().join(due, "fixture_id", "left_semi")), batch_id)

    return run


def start_sweep(changes: DataFrame, read_prices, read_upcoming, write, checkpoint: str, every: str = "120 seconds"):
    """Sweeps every two minutes; the checkpoint is the watermark of what has been judged."""
    return changes.writeStream.foreachBatch(sweep_batch(read_prices, read_upcoming, write)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def fresh(rows: DataFrame, as_of: Column, seconds: int = control.STALE_SECONDS) -> DataFrame:
    """Lanes and whether their last event is recent enough."""
    return rows.withColumn("alive", F.col("last_at") >= as_of - F.make_interval(secs=F.lit(float(seconds))))
