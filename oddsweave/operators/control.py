"""Control plane over worker events: state per lane, heartbeats, restart budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = "@@SYNC_EVENT@@"
WORKER_EVENT = "type string, lane string, pid long, at timestamp, cycle int, running boolean, durationMs long, ok boolean, heartbeatMs long, source string, error string, bookmakerSlug string, today int, tomorrow int"
STALE_SECONDS, RESTARTS, RESTART_MINUTES = 90, 5, 30


def parse_lines(lines: DataFrame, column: str = "value", prefix: str = PREFIX) -> DataFrame:
    """Worker events from output lines; lines without the prefix, a type or a lane are dropped."""
    body = F.substring(F.col(column), len(prefix) + 1, 1 << 30)
    events = lines.filter(F.col(column).startswith(prefix)).select(F.from_json(body, WORKER_EVENT).alias("e")).select("e.*")
    return events.filter("type IS NOT NULL AND lane IS NOT NULL")


def lane_state(events: DataFrame, lane: str, ts: str, order: str) -> DataFrame:
    """Per lane the latest event, its type, and how many there were."""
    key = F.struct(F.col(ts), F.col(order))
    return events.groupBy(lane).agg(F.max(ts).alias("last_at"), F.max_by("event_type", key).alias("last_type"), F.count(F.lit(1)).alias("n_events"))


def stale_gaps(events: DataFrame, lane: str, ts: str, order: str, seconds: int = STALE_SECONDS, hours: int = 24) -> DataFrame:
    """Per lane how often it was silent for longer than allowed, and the longest silence.

    A lane's history is taken in buckets of ``hours``, so it isn't one task's;
    the last time of the bucket before is carried in by one row a bucket.
    """
    rows = events.withColumn("_bucket", F.floor(F.unix_micros(F.col(ts)) / (hours * 3_600_000_000)))
    ends = rows.groupBy(lane, "_bucket").agg(F.max(ts).alias("_end"))
    edges = ends.withColumn("_edge", F.lag("_end").over(Window.partitionBy(lane).orderBy("_bucket"))).drop("_end")
    before = F.coalesce(F.lag(ts).over(Window.partitionBy(lane, "_bucket").orderBy(ts, order)), F.col("_edge"))
    gap = (F.unix_micros(F.col(ts)) - F.unix_micros(before)) / 1e6
    return rows.join(edges, [lane, "_bucket"]).withColumn("_gap", gap).groupBy(lane).agg(F.count_if(F.col("_gap") > seconds).alias("n_stale"), F.max("_gap").alias("longest_gap"))


def restart_budget(restarts: DataFrame, lane: str, ts: str, minutes: int = RESTART_MINUTES, most: int = RESTARTS) -> DataFrame:
    """``restarts`` with the number of restarts of the lane in the window up to each, whether it is within budget, and the cooldown.

    A window lies in its end's bucket and the one before, so each row goes to its
    own and the next bucket, and a lane's history is not one task's.
    """
    width = minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col(ts))
    own = F.floor(micros / width)
    spread = restarts.withColumn("_next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", own + F.col("_next"))
    window = Window.partitionBy(lane, "_bucket").orderBy(micros).rangeBetween(-width, Window.currentRow)
    counted = spread.withColumn("in_window", F.count(F.lit(1)).over(window)).filter("_next = 0").drop("_next", "_bucket")
    return counted.withColumn("allowed", F.col("in_window") <= most).withColumn("cooldown_s", cooldown(F.col("in_window")))


def cooldown(n: Column) -> Column:
    return 5 * F.least(n, F.lit(6))


#: Seconds that a cycle may take, by lane; lanes that aren't named take the first.
CYCLE_SECONDS = {"fast": 25 * 60, "meridianbet": 45 * 60, "bet365": 45 * 60}


def watchdog(events: DataFrame, as_of: Column, pauses: DataFrame | None = None, limits: dict[str, int] = CYCLE_SECONDS, stale: int = STALE_SECONDS) -> DataFrame:
    """Per lane whether it is paused, silent, stuck in a cycle, or well, as of a time.

    ``events``: lane, type (cycle-start, cycle-end, heartbeat and others), at;
    every event is a sign of life.  A cycle is open if the latest start has no
    end after it.  ``pauses`` (lane, until): a paused lane isn't judged until then.
    """
    seconds = lambda c: (F.unix_micros(as_of) - F.unix_micros(c)) / 1e6
    at = lambda kind: F.max(F.when(F.col("type") == kind, F.col("at")))
    lanes = events.filter(F.col("at") <= as_of).groupBy("lane").agg(F.max("at").alias("last_at"), at("cycle-start").alias("began_at"), at("cycle-end").alias("ended_at"))
    if pauses is None:
        lanes = lanes.withColumn("until", F.lit(None).cast("timestamp"))
    else:
        lanes = lanes.join(pauses.groupBy("lane").agg(F.max("until").alias("until")), "lane", "left")
    limit = F.coalesce(F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))[F.col("lane").cast("string")], F.lit(next(iter(limits.values()))))
    open_ = F.col("began_at").isNotNull() & (F.col("ended_at").isNull() | (F.col("ended_at") < F.col("began_at")))
    state = F.when(F.col("until") > as_of, "paused").when(seconds(F.col("last_at")) > stale, "silent").when(open_ & (seconds(F.col("began_at")) > limit), "stuck").otherwise("well")
    return lanes.select("lane", state.alias("state"), "last_at", F.when(open_, F.col("began_at")).alias("cycle_began_at"))
