"""Streams with state and timers of their own: jobs that fall silent without any further event, and tails of growing logs.

State is one small row for each open job or unfinished line, kept by the RocksDB store, so it doesn't live on the heap; it is cleared when a
job ends or a line is whole."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the process in which Spark first looks at a processor has no packages but its own, so processors travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class JobStates(StatefulProcessor):
    """Each job's newest event. A terminal one ends the job and clears its state; a job that is silent for longer than allowed is interrupted by
    its timer, with no event needed."""

    def __init__(self, silent_seconds: int, terminal: tuple[str, ...]):
        self.silent, self.terminal = silent_seconds * 1000, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "ts timestamp, event_id long, event_type string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names that Spark calls
        held = self.job.get()
        ts, event, kind, n = held if held is not None else (None, None, None, 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            if ts is not None and (r.ts, r.event_id) < (ts, event):
                n += 1  # late, but not newer than what is known
                continue
            ts, event, kind, n = r.ts, r.event_id, r.event_type, n + 1
            if kind in self.terminal:
                yield Row(job_id=key[0], state=kind, heartbeat=ts, n_events=n)
                ts, event, kind, n = None, None, None, 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ts is None:
            self.job.clear()
            return
        self.job.update((ts, event, kind, n))
        by_event = timerValues.getCurrentWatermarkInMs() if self.event_time else None
        start = int(ts.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        # what the watermark has passed already falls silent at the next look
        self.handle.registerTimer(max(start + self.silent, (by_event or 0) + 1))
        yield Row(job_id=key[0], state=kind, heartbeat=ts, n_events=n)

    event_time = False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        ts, _, _, n = self.job.get()
        self.job.clear()
        yield Row(job_id=key[0], state="interrupted", heartbeat=ts, n_events=n)

    def close(self) -> None:
        pass


class EventTimeJobStates(JobStates):
    """The same by the events' own clock: a timer goes off when the watermark passes it."""

    event_time = True


_STATES = "job_id long, state string, heartbeat timestamp, n_events long"


def job_states(events: DataFrame, silent_seconds: int, terminal: tuple[str, ...], late: str | None = None) -> DataFrame:
    """Updates of jobs from a stream of events (user_id, ts, event_id, event_type): the newest state after each batch, every end, and interruptions.

    With `late` the clock is the events' watermark, else that of the machine, which goes on without events."""
    rows = events.select("user_id", "ts", "event_id", "event_type")
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithState(EventTimeJobStates(silent_seconds, terminal) if late else JobStates(silent_seconds, terminal), _STATES, "Update", "EventTime" if late else "ProcessingTime")


class LogTails(StatefulProcessor):
    """Whole lines of each log from the parts that it grows by; what follows the last line's end waits for the next part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "size long, rest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        size, rest = self.tail.get() or (0, "")
        # parts of one batch are put in order; a new log that begins again at 0 comes after what the old one had before
        for r in sorted(rows, key=lambda r: (r.arrival, r.start)):
            end = r.start + len(r.content)
            if end < size or r.start > size:  # shorter than what was read, or another log altogether: from its start on
                size, rest = r.start, ""
            new = r.content[size - r.start :]
            *whole, rest = (rest + new).split("\n")
            at = end - len(rest) - sum(len(x) + 1 for x in whole)
            for line in whole:
                yield Row(log=key[0], start=at, line=line)
                at += len(line) + 1
            size = end
        self.tail.update((size, rest))

    def close(self) -> None:
        pass


def tailed_stream(parts: DataFrame) -> DataFrame:
    """(log, start, line): whole lines of growing logs, each once, with their place in characters.

    parts: a stream of (log, start, content, arrival): what a log holds from `start` on when it was looked at, in order of arrival. A part may repeat
    what was read; one that ends before that is a log that was begun anew, and is read from its start."""
    return parts.select("log", "start", "content", "arrival").groupBy("log").transformWithState(LogTails(), "log string, start long, line string", "Append", "None")


def text_parts(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Files `<log>@<start>@<arrival>.log` of a folder as a stream of parts."""
    whole = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_at_once).load(folder)
    name = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.log$", ""), "@")
    return whole.select(name[0].alias("log"), name[1].cast("long").alias("start"), name[2].cast("long").alias("arrival"), F.col("value").alias("content"))
