from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardspan.operators import alerts, scoring
from wardspan.sources import sinks

T0 = datetime(2024, 1, 1, 8)


def raised(spark, n):
    return spark.createDataFrame([(f"u{i}", i, T0 + timedelta(hours=i), "new_user", "Low") for i in range(n)], "user string, event_id long, event_ts timestamp_ntz, alert_type string, severity string")


def test_an_alert_with_its_id_back(spark, tmp_path):
    table = sinks.alert_table(spark, str(tmp_path / "a"), 8)
    details = F.to_json(F.struct("event_id", F.lit(None).cast("string").alias("none")))
    one = alerts.add(table, raised(spark, 1), details=details).first()
    assert (one["status"], one["title"], one["details"]) == ("Open", "Low new user for u0", '{"event_id":0}')
    got = alerts.by_id(table, one["alert_id"]).first()
    assert got["details"] == {"event_id": "0"} and got["user"] == "u0" and alerts.by_id(table, 5).count() == 0
    closed = alerts.change(table, spark.createDataFrame([(one["alert_id"], "Acknowledged", T0 + timedelta(hours=1)), (one["alert_id"], "Resolved", T0 + timedelta(hours=2)), (7, "Open", T0)], "alert_id long, status string, changed_at timestamp_ntz"))
    assert [(r["status"], r["resolved_at"]) for r in closed.collect()] == [("Resolved", T0 + timedelta(hours=2))]
    alerts.add(table, raised(spark, 3))  # the first is there already, and stays resolved
    assert sorted((r["user"], r["status"]) for r in table.read().collect()) == [("u0", "Resolved"), ("u1", "Open"), ("u2", "Open")]
    alerts.change(table, spark.createDataFrame([(one["alert_id"], "Open", T0 + timedelta(hours=3))], "alert_id long, status string, changed_at timestamp_ntz"))
    assert alerts.by_id(table, one["alert_id"]).first()["resolved_at"] is None
    with pytest.raises(ValueError):
        alerts.change(table, spark.createDataFrame([(1, None, T0)], "alert_id long, status string, changed_at timestamp_ntz"))
    broken = alerts.opened(spark.createDataFrame([("{",), ('{"a": 1}',), (None,)], "details string")).collect()
    assert [r["details"] for r in broken] == [{}, {"a": "1"}, {}]


def test_escalated_cases(spark):
    rows = alerts.created(raised(spark, 3).unionByName(raised(spark, 1).withColumn("event_id", F.lit(9).cast("long"))))
    cases = spark.createDataFrame([("u1", "Pending")], "user string, status string")
    got = alerts.escalated_cases(rows, rows.select("alert_id"), cases).collect()
    smallest = rows.filter("user = 'u0'").agg(F.min("alert_id")).first()[0]
    assert sorted((r["user"], r["status"]) for r in got) == [("u0", "Pending"), ("u2", "Pending")] and next(r["alert_id"] for r in got if r["user"] == "u0") == smallest


def test_seeded_scores(spark, tmp_path):
    path = str(tmp_path / "s")
    scores = spark.createDataFrame([("u", 0.1, 0.2, 0.3, 4), ("v", 0.5, 0.2, 0.3, 4)], "user string, ae_live double, rule_live double, rarity double, event_count long")
    sinks.seed_live_scores(spark, path, scores, T0)
    sinks.seed_live_scores(spark, path, scores.filter("user = 'u'").withColumn("ae_live", F.lit(0.9)), T0 + timedelta(days=1))
    assert {r["user"]: r["ae_live"] for r in sinks.current(spark, path, ["user"], ["updated_at"]).collect()} == {"u": 0.9, "v": 0.5}


def test_peer_means_and_context(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 5.0), ("b", 1, 4.0, 5.0), ("c", None, 9.0, 5.0), ("d", 2, 0.0, 1.0)], "user string, peer_group int, x double, y double")
    assert {r["user"]: r["x"] for r in scoring.means_of_peers(df, ["x"]).collect()} == {"a": 3.0, "b": 3.0, "d": 0.0}
    got = {r["user"]: r for r in scoring.peer_context(scoring.peer_ratios(df, ["x", "y"]), ["x", "y"], ["x"], n=1).collect()}
    assert got["a"]["peer_size"] == 2 and got["a"]["role_means"]["x"] == 3.0 and got["a"]["deviations"][0]["feature"] == "x" and len(got["d"]["deviations"]) == 1
