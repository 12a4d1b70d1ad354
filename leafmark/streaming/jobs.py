"""Job and activity streams: heartbeats, latest states, capacity, throughput windows. Each works on batch tables; those that take a
stream say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interrupted(jobs: DataFrame, silent_seconds: int) -> DataFrame:
    """Jobs whose last event isn't terminal and which were silent for longer than allowed before the newest event of all."""
    last = jobs.groupBy("job_id").agg(F.max("ts").alias("heartbeat"), F.max_by("terminal", F.struct("ts", "event_id")).alias("terminal"))
    now = last.agg(F.max("heartbeat").alias("now"))
    out = last.crossJoin(F.broadcast(now))  # one row
    silent = F.unix_timestamp("now") - F.unix_timestamp("heartbeat")
    return out.filter(~F.col("terminal") & (silent > silent_seconds)).select("job_id", "heartbeat")


def latest_state(jobs: DataFrame) -> DataFrame:
    """The newest event of each job; a streaming frame gives the same in update mode."""
    return jobs.groupBy("job_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("heartbeat"), F.count("*").alias("n_events"))


def open_jobs(jobs: DataFrame, most: int) -> DataFrame:
    """How many events of a user since the last terminal one, and whether another may be opened."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    closed = F.sum(F.col("terminal").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = jobs.withColumn("run", F.coalesce(closed, F.lit(0)))
    n = F.row_number().over(Window.partitionBy("job_id", "run").orderBy("ts", "event_id"))
    return rows.withColumn("open", n).select("event_id", "job_id", F.col("run").cast("long").alias("run"), "open", (n <= most).alias("allowed"))


def throughput(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events of each type in tumbling windows; on a stream, rows later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def feed(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events, at most 200 and at least 1."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(200, max(1, limit)))
