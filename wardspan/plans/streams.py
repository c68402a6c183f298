"""Queries that run the live side over the events table as a file stream.

The table is finished and its files may be in any order of time, so they are read in one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.plans.named import query
from wardspan.streaming import streams as S


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS \"user\", ts FROM events")
def dedup_stream(spark, sf_dir) -> DataFrame:
    """Every event twice in, once out."""
    stream = S.event_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=None)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return S.run_available(S.dedup(twice).select("event_id", "user", "ts")).drop("batch_")


@query("SELECT CAST(user_id AS VARCHAR) AS \"user\", CAST(ts AS DATE) AS day, count(*) AS event_count, round(sum(value), 4) AS value_sum FROM events GROUP BY ALL")
def tumbling_stream(spark, sf_dir) -> DataFrame:
    """Update mode: of each user and day the row of its last batch."""
    out = S.run_available(S.daily_counts(S.event_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=None)), "update")
    last = out.groupBy("user", "day").agg(F.max(F.struct("batch_", "event_count", "value_sum")).alias("l"))
    return last.select("user", "day", "l.event_count", "l.value_sum")


@query("""WITH w AS (SELECT CAST(user_id AS VARCHAR) AS "user", unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_end FROM events)
    SELECT "user", window_end, count(*) AS events_in_window FROM w GROUP BY ALL""")
def rolling_stream(spark, sf_dir) -> DataFrame:
    """The stream counts hours, and windows are sums of 24 of them, so the state has a row for each hour and none for each window."""
    return S.hopped(S.run_available(S.hourly_counts(S.event_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=None)), "update"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
    r AS (SELECT event_id, user_id, i, ts AS last, true AS fired FROM e WHERE i = 1
          UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.ts > r.last + INTERVAL 60 MINUTE THEN e.ts ELSE r.last END, e.ts > r.last + INTERVAL 60 MINUTE FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT event_id, CAST(user_id AS VARCHAR) AS "user" FROM r WHERE fired""")
def alert_stream(spark, sf_dir) -> DataFrame:
    return S.run_available(S.alerts(S.event_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=None))).select("event_id", "user")
