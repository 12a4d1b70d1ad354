"""Streams with state: time that passes without events, and lines that are split between runs."""

import datetime as dt
import time

from leafmark.streaming import feeds, timed

DAY = dt.datetime(2024, 1, 1)
TERMINAL = ("purchase", "error")


def test_silent_jobs_are_interrupted_without_any_event(spark, tmp_path):
    source, out = str(tmp_path / "events"), []
    rows = [(1, DAY, 1, "view"), (1, DAY + dt.timedelta(seconds=9), 2, "click"), (2, DAY, 3, "view"), (2, DAY + dt.timedelta(seconds=1), 4, "purchase"), (3, DAY, 5, "error"), (3, DAY + dt.timedelta(seconds=5), 6, "view")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, event_type string")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    with timed.rocks(spark):
        query = timed.job_states(stream, 3, TERMINAL).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").foreachBatch(lambda b, _: out.extend(b.collect())).start()
        try:
            end = time.time() + 60
            # nothing arrives from here on; only the clock goes on
            while time.time() < end and sum(r.state == "interrupted" for r in out) < 2:
                time.sleep(0.5)
        finally:
            query.stop()
    assert {(r.job_id, r.state, r.n_events) for r in out} == {(1, "click", 2), (2, "purchase", 2), (3, "error", 1), (3, "view", 1), (1, "interrupted", 2), (3, "interrupted", 1)}


def test_a_line_split_between_runs_comes_whole(spark, tmp_path):
    logs, folder = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()

    def run():
        with timed.rocks(spark):
            feeds.committed(timed.tailed_stream(timed.text_parts(spark, str(logs))), folder)
        return sorted((r.log, r.start, r.line) for r in spark.read.parquet(f"{folder}/batches").collect())

    (logs / "a@0@1.log").write_text("one\ntwo\nthr")
    (logs / "b@0@1.log").write_text("no end yet")
    first = run()
    assert first == [("a", 0, "one"), ("a", 4, "two")]
    (logs / "a@11@2.log").write_text("ee\n\nfour\n")
    (logs / "b@0@2.log").write_text("no end yet, but now\nrest")
    second = run()
    assert second == [*first, ("a", 8, "three"), ("a", 14, ""), ("a", 15, "four"), ("b", 0, "no end yet, but now")]
    (logs / "a@0@3.log").write_text("new\n")  # shorter than what was read: begun anew
    assert run() == sorted([*second, ("a", 0, "new")])
