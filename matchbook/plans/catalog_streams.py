"""Queries of the stateful streams: unanswered requests, cooldown per session, and
ingest against the stored identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchbook.operators import identity
from matchbook.plans.catalog import COOLDOWN_SECONDS, INGEST_SQL, _event_stream, _requests_of, query
from matchbook.plans.catalog_stores import new_root
from matchbook.sources.keyed_store import create_store, read_store
from matchbook.sources.tables import read_table
from matchbook.streaming.runner import read_stream_table, run_foreach_batch, run_to_table

REPLY_HOURS, REPLY_DELAY_MINUTES = 6, 10
UNANSWERED_SQL = f"""
WITH q AS (SELECT event_id AS request_id, user_id, ts FROM events WHERE event_type IN ('click', 'view')),
a AS (SELECT event_id AS reply_id, user_id, ts AS reply_ts FROM events WHERE event_type = 'purchase'),
wm AS (SELECT least((SELECT max(ts) FROM q), (SELECT max(reply_ts) FROM a)) - INTERVAL {REPLY_DELAY_MINUTES} MINUTE AS w),
m AS (SELECT q.request_id, q.user_id, a.reply_id FROM q JOIN a
      ON a.user_id = q.user_id AND a.reply_ts >= q.ts AND a.reply_ts <= q.ts + INTERVAL {REPLY_HOURS} HOUR)
SELECT request_id, user_id, reply_id, true AS answered FROM m
UNION ALL
SELECT request_id, user_id, NULL, false FROM q, wm
WHERE ts + INTERVAL {REPLY_HOURS} HOUR < w AND request_id NOT IN (SELECT request_id FROM m)
"""


@query("unanswered_requests_stream", UNANSWERED_SQL)
def q_unanswered_requests_stream(spark, sf):
    # a request whose bound the watermark has not passed yet is still open
    from matchbook.streaming.unanswered_stream import answered_requests
    events = _event_stream(spark, sf)
    asked = events.where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("request_id"), "user_id", "ts")
    given = _event_stream(spark, sf).where("event_type = 'purchase'").select(
        F.col("event_id").alias("reply_id"), "user_id", F.col("ts").alias("reply_ts"))
    joined = answered_requests(asked, given, "user_id", within=f"{REPLY_HOURS} HOURS", delay=f"{REPLY_DELAY_MINUTES} minutes")
    return run_to_table(joined, "unanswered").select(
        "request_id", "user_id", "reply_id", F.col("reply_id").isNotNull().alias("answered"))


SESSION_COOLDOWN_SQL = f"""
WITH RECURSIVE req AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, implementation, session ORDER BY ts, event_id) AS rn FROM (
    SELECT event_id, user_id, ts, CAST(date_trunc('week', ts) AS DATE) AS session,
           CASE WHEN event_type IN ('click', 'view') THEN 'FastText' ELSE 'LLM' END AS implementation FROM events)),
walk AS (
  SELECT user_id, implementation, session, rn, event_id, ts, ts AS last_ts, true AS accepted FROM req WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.implementation, r.session, r.rn, r.event_id, r.ts,
         CASE WHEN r.ts >= w.last_ts + INTERVAL {COOLDOWN_SECONDS} SECOND THEN r.ts ELSE w.last_ts END,
         r.ts >= w.last_ts + INTERVAL {COOLDOWN_SECONDS} SECOND
  FROM walk w JOIN req r
    ON r.user_id = w.user_id AND r.implementation = w.implementation AND r.session = w.session AND r.rn = w.rn + 1)
SELECT user_id, implementation, session, event_id, accepted,
       CASE WHEN NOT accepted
            THEN floor(({COOLDOWN_SECONDS} - (epoch(ts) - epoch(last_ts))) / 60)::BIGINT END AS wait_minutes
FROM walk
"""


@query("session_cooldown_stream", SESSION_COOLDOWN_SQL)
def q_session_cooldown_stream(spark, sf):
    # a week stands for a user's session
    from matchbook.streaming.session_cooldown import session_cooldown_stream, timer_state
    asked = _requests_of(_event_stream(spark, sf)).withColumn("session", F.to_date(F.date_trunc("week", "ts")))
    with timer_state(spark):
        return run_to_table(session_cooldown_stream(asked, ["user_id", "implementation", "session"], "ts", "event_id",
                                                    COOLDOWN_SECONDS, "1 hour"), "session-cooldown")


@query("ingest_to_store_stream", INGEST_SQL)
def q_ingest_to_store_stream(spark, sf):
    # landed latest postings first, a file a micro-batch: the store must still
    # end with the first posting of every identity
    from matchbook.streaming.store_ingest import store_ingest
    e = read_table(spark, sf, "events")
    keyed = e.select(identity.job_hash(F.col("user_id").cast("string"), F.col("event_type"), F.col("ts")).alias("job_hash"),
                     "event_id", "user_id", "event_type")
    root, landed = new_root(spark, "identities"), new_root(spark, "landed")
    bounds = e.agg(F.expr("percentile(event_id, array(0.33, 0.66))")).first()[0]
    late = [keyed.where(F.col("event_id") > bounds[1]),
            keyed.where((F.col("event_id") > bounds[0]) & (F.col("event_id") <= bounds[1])),
            keyed.where(F.col("event_id") <= bounds[0])]
    for part in late:
        part.write.mode("append").parquet(landed)
    create_store(keyed.limit(0), root, "job_hash", parts=16)
    arriving = read_stream_table(spark, landed, keyed.schema, max_files_per_trigger=8)
    run_foreach_batch(arriving, "store-ingest", store_ingest(root, new_root(spark, "changes"), "event_id"))
    return read_store(spark, root)
