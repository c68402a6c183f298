"""Queries on a user's earlier events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions import patterns as P
from wardspan.operators import history as H
from wardspan.plans.activity import LIVE_FEATURES, LIVE_SQL, OFF, live_events
from wardspan.plans.named import query
from wardspan.sources.tables import EVENTS_SQL, events

NUMBERED = 'n AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY event_ts, event_id) AS seq FROM ev)'


def unseen_sql(key: str, counts: str) -> str:
    return f'({counts} AND (lag(seq) OVER (PARTITION BY "user", {key} ORDER BY seq) IS NULL OR seq - lag(seq) OVER (PARTITION BY "user", {key} ORDER BY seq) > {H.CAP}))'


FIRST = unseen_sql("lower(trim(action))", "trim(action) <> ''")
NEW_IP = unseen_sql("trim(ip_address)", "trim(ip_address) NOT IN ('127.0.0.1', '::1', 'localhost', '')")
GEO = unseen_sql("upper(trim(country))", "trim(country) <> ''")
HIGH = f"least(seq - 1, {H.CAP}) > {H.MANY}"
FLAGS_SQL = f"""flags AS (SELECT *, CAST(first_time_action AS INTEGER) + CAST(new_ip AS INTEGER) + CAST(off_hours AS INTEGER) + CAST(high_volume AS INTEGER) + CAST(sensitive_resource AS INTEGER)
    + CAST(geo_rarity AS INTEGER) AS flags_fired FROM (SELECT *, {FIRST} AS first_time_action, {NEW_IP} AS new_ip, {OFF} AS off_hours, {HIGH} AS high_volume,
    regexp_matches(resource, '(?i)({P.SENSITIVE_RESOURCE})') AS sensitive_resource, {GEO} AS geo_rarity FROM n))"""


@query(f"WITH {EVENTS_SQL}, {NUMBERED} SELECT event_id, {FIRST} AS first_time_action FROM n")
def first_time_action(spark, sf_dir) -> DataFrame:
    return H.first_time_action(H.numbered(events(spark, sf_dir))).select("event_id", "first_time_action")


@query(f"WITH {EVENTS_SQL}, {NUMBERED} SELECT event_id, {NEW_IP} AS new_ip FROM n")
def new_ip(spark, sf_dir) -> DataFrame:
    return H.new_ip(H.numbered(events(spark, sf_dir))).select("event_id", "new_ip")


@query(f"WITH {EVENTS_SQL}, {NUMBERED} SELECT event_id, {GEO} AS geo_rarity FROM n")
def geo_rarity(spark, sf_dir) -> DataFrame:
    return H.geo_rarity(H.numbered(events(spark, sf_dir))).select("event_id", "geo_rarity")


@query(f"WITH {EVENTS_SQL}, {NUMBERED} SELECT event_id, {HIGH} AS high_volume FROM n")
def high_volume(spark, sf_dir) -> DataFrame:
    return H.numbered(events(spark, sf_dir)).select("event_id", H.high_volume().alias("high_volume"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, count(*) OVER (PARTITION BY "user" ORDER BY event_ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 > 1 AS high_volume_1h FROM ev""")
def high_volume_1h(spark, sf_dir) -> DataFrame:
    """With more than 1 instead of 50, as the table's users are quieter."""
    return H.high_volume_in(events(spark, sf_dir), 1, 1).select("event_id", F.col("high_volume_in").alias("high_volume_1h"))


_over = 'OVER (PARTITION BY "user" ORDER BY event_ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)'


@query(f"WITH {EVENTS_SQL}, {LIVE_SQL} SELECT event_id, count(*) {_over} AS events_in_window, " + ", ".join(f"CAST(sum({c}) {_over} AS BIGINT) AS {c}_in_window" for c in LIVE_FEATURES) + " FROM live")
def rolling_24h_features(spark, sf_dir) -> DataFrame:
    return H.rolling(live_events(spark, sf_dir), LIVE_FEATURES).select("event_id", "events_in_window", *[f"{c}_in_window" for c in LIVE_FEATURES])


@query(f'WITH {EVENTS_SQL} SELECT event_id, row_number() OVER (PARTITION BY "user" ORDER BY event_ts, event_id) AS total_events FROM ev')
def running_event_count(spark, sf_dir) -> DataFrame:
    return H.numbered(events(spark, sf_dir)).select("event_id", F.col("seq").alias("total_events"))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT *, CAST(event_ts AS DATE) AS day FROM ev), m AS (SELECT *, day = max(day) OVER (PARTITION BY "user") AS is_latest FROM d)
    SELECT "user", max(day) AS latest_day, count(*) FILTER (is_latest) AS in_window, count(*) FILTER (NOT is_latest) AS in_history FROM m GROUP BY "user" """)
def latest_day_window(spark, sf_dir) -> DataFrame:
    e = H.split_latest_day(events(spark, sf_dir).withColumn("day", F.to_date("event_ts")))
    return e.groupBy("user").agg(F.max("day").alias("latest_day"), F.count_if("is_latest").alias("in_window"), F.count_if(~F.col("is_latest")).alias("in_history"))


@query(f'WITH {EVENTS_SQL} SELECT "user", event_ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY event_ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1')
def latest_score_per_user(spark, sf_dir) -> DataFrame:
    return H.latest(events(spark, sf_dir).select("user", "event_ts", "event_id", "value"), ["user"], ["event_ts", "event_id"])


@query(f"WITH {EVENTS_SQL}, {NUMBERED}, {FLAGS_SQL} SELECT event_id, {', '.join(H.FLAGS)}, flags_fired, round(flags_fired / 6.0, 4) AS rarity FROM flags")
def rarity_flags(spark, sf_dir) -> DataFrame:
    return H.rarity_flags(events(spark, sf_dir)).select("event_id", *H.FLAGS, "flags_fired", "rarity")


@query(f'WITH {EVENTS_SQL}, {NUMBERED}, {FLAGS_SQL} SELECT "user", count(*) AS n, round(CAST(sum(flags_fired) AS DOUBLE) / (6 * count(*)), 6) AS mean_rarity, round(max(flags_fired) / 6.0, 4) AS max_rarity FROM flags GROUP BY "user"')
def rarity_score_user(spark, sf_dir) -> DataFrame:
    return H.rarity_flags(events(spark, sf_dir)).groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flags_fired").cast("double") / (6 * F.count(F.lit(1))), 6).alias("mean_rarity"), F.max("rarity").alias("max_rarity"))
