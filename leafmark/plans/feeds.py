"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.plans.base import query, tables
from leafmark.sources.shared import shared_folder
from leafmark.streaming import feeds as S
from leafmark.streaming import timed


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS heartbeat, count(*) AS n_events FROM events GROUP BY user_id")
def k02_streamed_states(spark, sf_dir):
    """The events as a stream, folded in update mode."""
    updates = S.drained(S.latest_states(S.events_stream(spark, f"{sf_dir}/events.parquet")), "states", "update")
    return S.newest(updates, "user_id")


_TERMINAL = ("purchase", "error")


@query("""WITH l AS (SELECT user_id AS job_id, max(ts) AS heartbeat, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id)
SELECT job_id, heartbeat FROM l WHERE state NOT IN ('purchase', 'error') AND heartbeat + INTERVAL 8 HOUR < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def k01_timed_jobs(spark, sf_dir):
    """Jobs that their timers have interrupted when the stream is empty, by the events' clock."""
    stream = S.events_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    with timed.rocks(spark):
        updates = S.drained(timed.job_states(stream, 8 * 3600, _TERMINAL, "2 hours"), "timed-jobs", "update")
    return S.newest(updates, "job_id").filter("state = 'interrupted'").select("job_id", F.col("heartbeat").cast("timestamp_ntz").alias("heartbeat"))


@query("""WITH r AS (SELECT *, coalesce(sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS heartbeat, count(*) AS n_events FROM r WHERE event_type IS NOT NULL GROUP BY user_id, run HAVING bool_or(event_type IN ('purchase', 'error'))""")
def k02_ended_jobs(spark, sf_dir):
    """Every end of a job, as the stream gives it."""
    stream = S.events_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    with timed.rocks(spark):
        updates = S.drained(timed.job_states(stream, 8 * 3600, _TERMINAL, "40 days"), "ended-jobs", "update")
    return updates.filter(F.col("state").isin(*_TERMINAL)).select("job_id", "state", F.col("heartbeat").cast("timestamp_ntz").alias("heartbeat"), "n_events")


@query("""WITH d AS (SELECT doc_id AS log, text, length(text) - strpos(reverse(text), chr(10)) + 1 AS n FROM documents WHERE contains(text, chr(10)))
SELECT log, CAST(n - length(replace(text[1:n], chr(10), '')) AS BIGINT) AS n_lines, md5(text[1:n]) AS digest FROM d""")
def k06_streamed_tail(spark, sf_dir):
    """Each text as a log that arrives in two parts, wherever its middle falls, read in two runs."""
    (docs,) = tables(spark, sf_dir, "documents")
    half = F.floor(F.char_length("text") / 2).cast("int")
    first = docs.select(F.col("doc_id").alias("log"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("arrival"), F.substr("text", F.lit(1), half).alias("content"))
    second = docs.select(F.col("doc_id").alias("log"), half.cast("long").alias("start"), F.lit(2).cast("long").alias("arrival"), F.substr("text", half + 1, F.char_length("text")).alias("content"))
    folder = shared_folder(spark, "log-parts")
    for part in (first, second):
        part.write.mode("append").parquet(f"{folder}/parts")
        with timed.rocks(spark):
            S.committed(timed.tailed_stream(spark.readStream.schema(part.schema).parquet(f"{folder}/parts").withColumn("log", F.col("log").cast("string"))), folder)
    lines = spark.read.schema("log string, start long, line string").parquet(f"{folder}/batches")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("start", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    return lines.groupBy(F.col("log").cast("long").alias("log")).agg(F.count("*").alias("n_lines"), F.md5(F.array_join(whole, "")).alias("digest"))


_SESSIONS = """g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(f"""WITH {_SESSIONS}, r AS (SELECT user_id, min(ts) AS started, max(ts) AS heartbeat, count(*) AS n, arg_max(event_type, (ts, event_id)) AS state FROM s GROUP BY user_id, session)
SELECT * FROM r WHERE heartbeat + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def k01_streamed_sessions(spark, sf_dir):
    """Sessions that the watermark has closed when the stream is empty."""
    stream = S.events_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = S.drained(S.silent_sessions(stream, "8 hours", "2 hours"), "sessions")
    return found.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("heartbeat").cast("timestamp_ntz").alias("heartbeat"), "n", "state")


@query(f"WITH {_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS heartbeat, count(*) AS n FROM s GROUP BY user_id, session")
def k07_sessions(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return S.sessions(events, 8 * 3600)


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(4)) AS k) o GROUP BY 1, 2")
def k07_sliding_throughput(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return S.sliding_throughput(events, "1 day", "6 hours")


@query("SELECT event_id, user_id, event_type <> 'error' AS ok FROM events")
def k03_committed_results(spark, sf_dir):
    """Page results committed batch by batch; each file of the table twice, as a replay would."""
    stream = S.events_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.drained(S.page_results(stream.unionByName(stream)), "results").select("event_id", "user_id", "ok")


@query(r"""WITH l AS (SELECT doc_id AS log, text AS content, length(text) AS n, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN CAST(floor(length(text) / 2) AS BIGINT) WHEN 2 THEN length(text) + 5 ELSE length(text) END AS o FROM documents),
b AS (SELECT *, CASE WHEN o > n THEN 0 ELSE o END AS b FROM l), r AS (SELECT *, substring(content, CAST(b + 1 AS BIGINT)) AS rest FROM b), w AS (SELECT *, CASE WHEN contains(rest, chr(10)) THEN rest[1:length(rest) - strpos(reverse(rest), chr(10)) + 1] ELSE '' END AS whole FROM r)
SELECT log, CAST(CASE WHEN whole = '' THEN 0 ELSE length(whole) - length(replace(whole, chr(10), '')) END AS BIGINT) AS n_lines, md5(whole) AS digest, CAST(b + length(whole) AS BIGINT) AS "offset" FROM w""")
def k06_tailed(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    n = F.char_length("text")
    offset = F.when(F.col("doc_id") % 4 == 1, F.floor(n / 2)).when(F.col("doc_id") % 4 == 2, n + 5).when(F.col("doc_id") % 4 == 3, n).otherwise(0)
    found = S.tailed(docs.select(F.col("doc_id").alias("log"), F.col("text").alias("content")), docs.select(F.col("doc_id").alias("log"), offset.cast("long").alias("offset")))
    whole = F.when(F.size("lines") == 0, "").otherwise(F.concat(F.array_join("lines", "\n"), F.lit("\n")))
    return found.select("log", F.size("lines").cast("long").alias("n_lines"), F.md5(whole).alias("digest"), "offset")


# some jobs run for hours, some for days, and a few never end
_JOBS = "SELECT event_id AS job, CASE WHEN event_id % 50 <> 7 THEN user_id END AS user, ts AS started, CASE WHEN event_id % 97 = 4 THEN CAST(NULL AS TIMESTAMP{ntz}) WHEN event_id % 9 = 4 THEN ts + INTERVAL {long} WHEN event_id % 31 = 6 THEN ts ELSE ts + INTERVAL {short} END AS ended FROM {t}"


@query(f"""WITH j AS MATERIALIZED ({_JOBS.format(ntz='', long='3 DAY', short='3 HOUR', t='events')}),
n AS (SELECT a.job, count(*) AS open, count(*) FILTER (b.user = a.user) AS own FROM j a JOIN j b ON b.started < a.started AND (b.ended IS NULL OR b.ended > a.started) GROUP BY a.job)
SELECT job, coalesce(open, 0) AS open, coalesce(own, 0) AS own, coalesce(open, 0) < 40 AND coalesce(own, 0) < 1 AS allowed FROM j LEFT JOIN n USING (job)""")
def k05_capacity(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return S.capacity(spark.sql(_JOBS.format(ntz="_NTZ", long="3 DAY", short="3 HOUR", t="{e}"), e=events), 40, 1)
