"""Queries on alerts and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions import times as T
from wardspan.operators import alerts as A
from wardspan.operators import cases as C
from wardspan.operators import catalog
from wardspan.operators import history as H
from wardspan.operators.cuts import cut
from wardspan.plans.history import FLAGS_SQL, NUMBERED
from wardspan.plans.named import query
from wardspan.plans.scores import SCORES_SQL, user_scores
from wardspan.sources.sinks import alert_table as alert_store
from wardspan.sources.sinks import event_store
from wardspan.sources.tables import EVENTS_SQL, events, table
from wardspan.streaming.streams import scratch

CANDIDATES_SQL = f"""{EVENTS_SQL}, {NUMBERED}, {FLAGS_SQL}, candidates AS (
  SELECT "user", event_id, event_ts, 'new_user' AS alert_type, 'Low' AS severity FROM flags WHERE seq = 1
  UNION ALL SELECT "user", event_id, event_ts, 'rarity_spike', CASE WHEN round(flags_fired / 6.0, 4) >= 0.8 THEN 'Critical' ELSE 'High' END FROM flags WHERE round(flags_fired / 6.0, 4) >= 0.6
  UNION ALL SELECT "user", event_id, event_ts, 'anomalous_behavior', 'High' FROM flags WHERE first_time_action AND off_hours)"""


def candidates(spark, sf_dir) -> DataFrame:
    return A.candidates(H.rarity_flags(events(spark, sf_dir)))


@query(f"WITH {CANDIDATES_SQL} SELECT * FROM candidates")
def alert_candidates(spark, sf_dir) -> DataFrame:
    return candidates(spark, sf_dir)


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_id, user_id, i, ts AS last, true AS fired FROM e WHERE i = 1
          UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.ts > r.last + INTERVAL 60 MINUTE THEN e.ts ELSE r.last END, e.ts > r.last + INTERVAL 60 MINUTE FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT event_id, CAST(user_id AS VARCHAR) AS "user", fired FROM r""")
def alert_suppression(spark, sf_dir) -> DataFrame:
    """Every event stands for an alert of one type."""
    e = events(spark, sf_dir).select("event_id", "user", "event_ts", F.lit("any").alias("alert_type"))
    return A.suppress(e).select("event_id", "user", "fired")


@query(f"""WITH {SCORES_SQL} SELECT "user", 'high_risk' AS alert_type, CASE WHEN score >= 0.85 THEN 'Critical' ELSE 'High' END AS severity, 'Open' AS status FROM scores WHERE score >= 0.33""")
def rebuild_alerts(spark, sf_dir) -> DataFrame:
    return A.rebuild(user_scores(spark, sf_dir), 0.33)


ALERTS_SQL = f"""{CANDIDATES_SQL}, alerts AS (SELECT event_id * 10 + CASE alert_type WHEN 'new_user' THEN 0 WHEN 'rarity_spike' THEN 1 ELSE 2 END AS alert_id, "user", alert_type,
    ['Open', 'Acknowledged', 'Resolved', 'False Positive'][event_id % 4 + 1] AS status, event_ts FROM candidates)"""


def alerts(spark, sf_dir) -> DataFrame:
    """The candidates as stored alerts in states by their event's number."""
    c = candidates(spark, sf_dir)
    number = F.col("event_id") * 10 + F.when(F.col("alert_type") == "new_user", 0).when(F.col("alert_type") == "rarity_spike", 1).otherwise(2)
    status = F.element_at(F.array(*map(F.lit, A.STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    return c.select(number.alias("alert_id"), "user", "alert_type", status.alias("status"), "event_ts")


@query(f"WITH {ALERTS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'Open') AS open, count(*) FILTER (status = 'Acknowledged') AS acknowledged, count(*) FILTER (status = 'Resolved') AS resolved, count(*) FILTER (status = 'False Positive') AS false_positive FROM alerts")
def alert_summary(spark, sf_dir) -> DataFrame:
    return A.status_counts(alerts(spark, sf_dir))


@query(f"WITH {ALERTS_SQL} SELECT alert_id, \"user\", alert_type, status FROM alerts WHERE status = 'Open' ORDER BY event_ts DESC, alert_id DESC LIMIT 50")
def newest_open_alerts(spark, sf_dir) -> DataFrame:
    return alerts(spark, sf_dir).filter("status = 'Open'").orderBy(F.desc("event_ts"), F.desc("alert_id")).limit(50).select("alert_id", "user", "alert_type", "status")


@query("SELECT user_id AS alert_id, status, CASE WHEN status IN ('Resolved', 'False Positive') THEN ts END AS resolved_at FROM (SELECT *, ['Open', 'Acknowledged', 'Resolved', 'False Positive'][event_id % 4 + 1] AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def alert_status_log(spark, sf_dir) -> DataFrame:
    """Events as changes of the state of the alert with the user's number."""
    status = F.element_at(F.array(*map(F.lit, A.STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    return A.current_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), status.alias("status"), F.col("ts").alias("changed_at")))


@query(f"""WITH {ALERTS_SQL}, v AS (SELECT DISTINCT "user", CASE WHEN CAST("user" AS INTEGER) % 3 = 0 THEN 'Confirmed' ELSE 'Cleared' END AS verdict FROM ev WHERE CAST("user" AS INTEGER) % 2 = 0)
    SELECT alert_id, a."user", CASE WHEN status IN ('Open', 'Acknowledged') AND verdict = 'Confirmed' THEN 'Resolved' WHEN status IN ('Open', 'Acknowledged') AND verdict = 'Cleared' THEN 'False Positive' ELSE status END AS status
    FROM alerts a LEFT JOIN v ON a."user" = v."user" """)
def resolve_alerts(spark, sf_dir) -> DataFrame:
    number = F.col("user").cast("int")
    verdicts = events(spark, sf_dir).filter(number % 2 == 0).select("user", F.when(number % 3 == 0, "Confirmed").otherwise("Cleared").alias("verdict")).distinct()
    return A.resolve_on_verdict(alerts(spark, sf_dir), verdicts).select("alert_id", "user", "status")


@query(f"WITH {ALERTS_SQL} SELECT alert_id, CASE WHEN alert_id % 7 = 0 THEN 'Acknowledged' ELSE status END AS status, alert_id % 7 = 0 AS escalated FROM alerts")
def escalate_alerts(spark, sf_dir) -> DataFrame:
    a = alerts(spark, sf_dir)
    return A.escalate(a, a.filter("alert_id % 7 = 0")).select("alert_id", "status", "escalated")


def case_log(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, C.CASE_STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    e = events(spark, sf_dir).filter("source = 'aws_cloudtrail'")
    return e.select("user", F.col("event_ts").alias("saved_at"), status.alias("status"), F.lit("analyst").alias("analyst"), F.col("action").alias("note"))


CASES_SQL = f"""{EVENTS_SQL}, log AS (SELECT *, ['Pending', 'Under Review', 'Confirmed', 'Cleared'][event_id % 4 + 1] AS status FROM ev WHERE source = 'aws_cloudtrail'),
  cases AS (SELECT "user", arg_max(status, event_ts) AS status, arg_max(action, event_ts) AS notes, min(event_ts) AS created_at, max(event_ts) AS updated_at, CAST(count(*) - 1 AS INTEGER) AS entries FROM log GROUP BY "user")"""


@query(f"WITH {CASES_SQL} SELECT * FROM cases")
def case_history(spark, sf_dir) -> DataFrame:
    return C.records(case_log(spark, sf_dir)).select("user", "status", "notes", "created_at", "updated_at", F.size("history").alias("entries"))


@query(f"WITH {CASES_SQL} SELECT \"user\", status FROM cases WHERE status = 'Pending' ORDER BY updated_at DESC, \"user\" LIMIT 20")
def newest_pending_cases(spark, sf_dir) -> DataFrame:
    return C.list_cases(C.records(case_log(spark, sf_dir)), "Pending", 20).select("user", "status")


@query(f"""WITH {SCORES_SQL} SELECT "user", 'Pending' AS status, '' AS analyst FROM scores WHERE score >= 0.3 AND "user" NOT IN (SELECT "user" FROM ev WHERE source = 'aws_cloudtrail' AND k < 5)""")
def bulk_import_cases(spark, sf_dir) -> DataFrame:
    known = events(spark, sf_dir).filter("source = 'aws_cloudtrail' AND k < 5").select("user").distinct()
    return C.bulk_import(user_scores(spark, sf_dir), known, 0.3)


@query(f"""WITH {CANDIDATES_SQL} SELECT "user", alert_type, severity, event_ts AS created_at, CASE event_id % 4 WHEN 2 THEN 'Resolved' WHEN 3 THEN 'False Positive' WHEN 1 THEN 'Acknowledged' ELSE 'Open' END AS status,
    CASE WHEN event_id % 4 >= 2 THEN event_ts + INTERVAL 2 HOURS END AS resolved_at, CAST(event_id AS VARCHAR) AS event_id FROM candidates""")
def alert_table(spark, sf_dir) -> DataFrame:
    """Candidates put into an alert table twice over, most of them acknowledged and half of those closed, then read with their details."""
    raised = cut(candidates(spark, sf_dir))
    with scratch(spark) as folder:
        store = alert_store(spark, folder, 8)
        details = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id")))
        A.add(store, raised.filter("event_id % 3 > 0"), details=details)
        A.add(store, raised, details=details)
        number = F.get_json_object("details", "$.event_id").cast("long")
        known = store.read().withColumn("n", number % 4)
        hours = lambda h: F.col("created_at") + F.expr(f"INTERVAL {h} HOURS")
        first = known.filter("n > 0").select("alert_id", F.lit("Acknowledged").alias("status"), hours(1).alias("changed_at"))
        last = known.filter("n > 1").select("alert_id", F.when(F.col("n") == 2, "Resolved").otherwise("False Positive").alias("status"), hours(2).alias("changed_at"))
        A.change(store, first)
        A.change(store, last)
        told = A.opened(store.read())
        return cut(told.select("user", "alert_type", "severity", "created_at", "status", "resolved_at", F.col("details")["event_id"].alias("event_id")))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT *, event_ts + to_hours(CAST(event_id * 7 % 30 AS INTEGER)) + to_microseconds(event_id) AS ingested_at FROM ev)
    SELECT event_id, "user", ingested_at FROM e WHERE ingested_at >= (SELECT max(ingested_at) FROM e) - INTERVAL 24 HOURS""")
def events_by_ingest(spark, sf_dir) -> DataFrame:
    """All events that were taken in within the last day, from an event store that was written in two parts."""
    e = events(spark, sf_dir)
    at = F.timestamp_micros(T.micros(e, "event_ts") + F.col("event_id") * 7 % 30 * 3_600_000_000 + F.col("event_id"))
    e = e.withColumn("ingested_at", T.utc_clock(at))
    with scratch(spark) as folder:
        store = event_store(spark, folder, 16)
        store.write(e.filter("event_id % 2 = 0"))
        store.write(e.filter("event_id % 2 = 1"))
        rows = store.read()
        newest = rows.agg(F.max("ingested_at")).first()[0]
        return cut(catalog.recent_events(rows, None, newest, 24).select("event_id", "user", "ingested_at"))
