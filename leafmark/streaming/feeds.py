"""Streams of events and page results: states, sessions and commits by micro-batches, drained with availableNow or run on.

A micro-batch is written to a folder of its own number, over what an earlier try left there, so a replay after a lost driver or executor
changes nothing; the checkpoint and the folders lie where all executors see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import shared_folder


def events_stream(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A folder or a file of Parquet events as a stream, some files at a time. A stream takes a single file by a pattern only."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")


def committed(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream to the end of what there is now. A second call with the folder goes on after the last committed batch."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start()
    query.awaitTermination()


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives until its source is empty, with the number of their batch."""
    folder = shared_folder(stream.sparkSession, tag)
    committed(stream, folder, mode)
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/batches")


def latest_states(events: DataFrame) -> DataFrame:
    """Each job's newest event so far; as a stream in update mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("heartbeat"), F.count("*").alias("n_events"))


def newest(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    one = updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return one.select(key, *(F.col("r")[c].alias(c) for c in rest))


def silent_sessions(events: DataFrame, silent: str, late: str) -> DataFrame:
    """Sessions of jobs that fell silent: from the first event to the last, closed once the watermark has passed their end.

    State is one row for each open session, and goes when it is closed."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", silent).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("heartbeat"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return by.select("user_id", F.col("w.start").alias("started"), "heartbeat", "n", "state")


def sliding_throughput(events: DataFrame, width: str, step: str) -> DataFrame:
    """Events of each type in overlapping windows."""
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def page_results(events: DataFrame) -> DataFrame:
    """What is kept of a stream of page results: the page, what became of it, and no more than one row for an event id within a day."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", (F.col("event_type") != "error").alias("ok"))


def tailed(logs: DataFrame, offsets: DataFrame) -> DataFrame:
    """New whole lines of each log after its offset, and the next offset; a log shorter than its offset is read from the start.

    logs: (log, content); offsets: (log, offset), counted in characters. A last line without its end waits."""
    both = logs.join(offsets, "log", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    size = F.char_length("content")
    both = both.withColumn("begin", F.when(F.col("offset") > size, 0).otherwise(F.col("offset")))
    both = both.withColumn("rest", F.substr("content", (F.col("begin") + 1).cast("int"), size))
    whole = size - F.col("begin") - F.when(F.col("rest").contains("\n"), F.instr(F.reverse("rest"), "\n") - 1).otherwise(size - F.col("begin"))
    both = both.withColumn("whole", F.substr("rest", F.lit(1), whole.cast("int")))
    lines = F.when(F.col("whole") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("whole", "\n$", ""), "\n"))
    return both.select("log", lines.alias("lines"), (F.col("begin") + F.char_length("whole")).cast("long").alias("offset"))


def _open_at(jobs: DataFrame, by: list[str], width: str) -> DataFrame:
    """(by, at, open): jobs open at each time at which one starts, those that start or end at that very time not among them.

    A running sum of +1 and -1 in three levels: changes at one time, sums within a range of times, and what ranges before carry in; so a
    window holds one range's times, or one row for each range."""
    some = jobs.filter("ended is null or ended > started")
    change = F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("ended").alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    changes = some.select(*by, change.alias("c")).select(*by, "c.*").filter("at is not null")
    # jobs that are never open ask too
    changes = changes.unionAll(jobs.filter("ended <= started").select(*by, F.col("started").alias("at"), F.lit(0).alias("up"), F.lit(0).alias("down")))
    times = changes.groupBy(*by, "at").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).withColumn("range", F.date_trunc(width, "at"))
    ranges = times.groupBy(*by, "range").agg(F.sum(F.col("up") - F.col("down")).alias("net"))
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("range")
    carried = ranges.select(*(F.col(c).alias(f"of_{c}") for c in [*by, "range"]), F.coalesce(F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    inside = Window.partitionBy(*by, "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = times.withColumn("inside", F.sum(F.col("up") - F.col("down")).over(inside) - F.col("up"))
    same = F.col("range") == F.col("of_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return sums.join(carried, same).select(*by, "at", (F.col("carry") + F.col("inside")).alias("open"))


def capacity(jobs: DataFrame, most: int, each: int, width: str = "hour") -> DataFrame:
    """Starts of jobs with how many are open over all and for their user at that time, and whether both limits leave room.

    A job counts from after its start until its end, for ever if it has none; one without a user counts over all only.
    jobs: job, user, started, ended (null while open); width: a unit of date_trunc, the ranges of the running sums."""
    whole = _open_at(jobs, [], width).withColumnRenamed("at", "at_all")
    own = _open_at(jobs.filter("user is not null"), ["user"], width).select(F.col("user").alias("of"), F.col("at").alias("at_own"), F.col("open").alias("own"))
    both = jobs.select("job", "user", "started").join(whole, F.col("started") == F.col("at_all"), "left").join(own, (F.col("user") == F.col("of")) & (F.col("started") == F.col("at_own")), "left")
    both = both.select("job", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("open", "own")))
    return both.withColumn("allowed", (F.col("open") < most) & (F.col("own") < each))


def sessions(events: DataFrame, silent_seconds: int) -> DataFrame:
    """The same sessions from a table, open ones too."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = events.withColumn("new", F.when(gap < silent_seconds * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("heartbeat"), F.count("*").alias("n"))
