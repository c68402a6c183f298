"""History operators against loops over each user's events."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from wardspan.operators import alerts, cuts, history, ingest

DAY = datetime.datetime(2024, 1, 1)


def made(n=400, users=4, seed=3):
    rng = random.Random(seed)
    out = [(i, f"u{rng.randrange(users)}", DAY + datetime.timedelta(minutes=rng.randrange(20_000)), rng.choice(["a", "A ", "b", "c", ""]), rng.choice(["1.1.1.1", "2.2.2.2", "::1", ""])) for i in range(n)]
    return sorted(out, key=lambda r: (r[2], r[0]))


def test_unseen_with_a_cap_is_like_a_loop(spark):
    rows, cap = made(), 5
    df = spark.createDataFrame(rows, "event_id int, user string, event_ts timestamp_ntz, action string, ip_address string")
    got = {r["event_id"]: r["f"] for r in history.first_time_action(history.numbered(df), cap).select("event_id", F.col("first_time_action").alias("f")).collect()}
    seen = {}
    for i, user, _, action, _ in rows:
        recent = seen.setdefault(user, [])
        key = action.strip().lower()
        assert got[i] == (key != "" and key not in recent[-cap:]), i
        recent.append(key)


def test_suppression_is_greedy(spark):
    rows = [(r[0], r[1], r[2], "t") for r in made(300, 2, 5)]
    df = spark.createDataFrame(rows, "event_id int, user string, event_ts timestamp_ntz, alert_type string")
    got = {r["event_id"]: r["fired"] for r in alerts.suppress(df).collect()}
    last = {}
    for i, user, ts, _ in rows:
        fires = user not in last or ts - last[user] > datetime.timedelta(minutes=60)
        assert got[i] == fires
        if fires:
            last[user] = ts


def test_rules(spark):
    df = spark.createDataFrame([("u", 1, 0.9, 0.85, True, True), ("u", 2, 0.55, 0.6, True, False), ("u", 3, None, 0.1, None, True)], "user string, seq int, ae double, r double, f boolean, o boolean")
    rows = df.select("seq", alerts.rules(F.col("seq"), F.col("ae"), F.col("r"), F.col("f"), F.col("o")).alias("a")).collect()
    got = {r["seq"]: [(x["alert_type"], x["severity"]) for x in r["a"]] for r in rows}
    assert got == {1: [("new_user", "Low"), ("ae_critical", "Critical"), ("rarity_spike", "Critical"), ("anomalous_behavior", "High")], 2: [("ae_critical", "High"), ("rarity_spike", "High")], 3: []}


def test_latest_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, None)], "user string, at int, v int")
    assert sorted(map(tuple, history.latest(df, ["user"], ["at"]).collect())) == [("a", 2, 20), ("b", 1, None)]


def test_alerts_in_terminal_states_suppress_none(spark):
    rng = random.Random(5)
    statuses = alerts.STATUSES
    rows = [(i, f"u{rng.randrange(3)}", DAY + datetime.timedelta(minutes=rng.randrange(4000)), "x", rng.choice(statuses)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id int, user string, event_ts timestamp_ntz, alert_type string, status string")
    for status in (None, "status"):
        got = {r["event_id"]: r["fired"] for r in alerts.suppress(df, status=status).collect()}
        last = {}
        for i, user, at, _, state in sorted(rows, key=lambda r: (r[2], r[0])):
            fires = user not in last or at - last[user] > datetime.timedelta(minutes=60)
            assert got[i] == fires, (status, i)
            if fires and (status is None or state in ("Open", "Acknowledged")):
                last[user] = at


def test_flags_need_few_scans(spark, small, monkeypatch):
    """However many flags, the events are scanned twice at most: to number them, and to count their days."""
    from wardspan.operators import scoring
    from wardspan.plans import registry

    scans, cut = [], history.cut
    count = lambda df: scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
    for module in (history, scoring):
        monkeypatch.setattr(module, "cut", lambda df: count(df) or cut(df))
    for name, most in (("rarity_flags", 2), ("batch_rule_score", 2), ("weighted_average", 4)):
        scans.clear()
        count(registry.QUERIES[name](spark, small))
        assert sum(scans) <= most, (name, scans)


def test_seen_keys_take_one_join(spark):
    """Numbers in blocks: events meet only the flags that are true."""
    rows = spark.range(50).selectExpr("'u' AS user", "id + 1 AS seq", "concat('a', id % 7) AS action")
    out = history.first_time_action(rows, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert out.filter("first_time_action").count() == 50 and history.first_time_action(rows, 6 + 1).filter("first_time_action").count() == 7


def test_suppression_moves_rows_by_day_and_by_stretch_only(spark, monkeypatch):
    """Rows that come twice, null keys, null times and several states against a loop; the rows go out twice, the others are a day's times and sums."""
    cut_plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(alerts, "cut", lambda df: cut_plans.append(plan(df)) or cuts.cut(df))
    rng = random.Random(9)
    once = [
        (i % 90, rng.choice(["a", "b", None]), None if rng.random() < 0.05 else DAY + datetime.timedelta(minutes=rng.randrange(0, 6000, 20)), rng.choice(["x", None]), alerts.STATUSES[i % 90 % 4])
        for i in range(500)
    ]
    df = spark.createDataFrame(once + once, "event_id int, user string, event_ts timestamp_ntz, alert_type string, status string").repartition(5)
    for status in (None, "status"):
        out = alerts.suppress(df, status=status)
        assert out.columns == [*df.columns, "fired"]
        want, last = Counter(), {}
        for i, user, ts, kind, state in sorted(once + once, key=lambda r: (r[2] or datetime.datetime.min, r[0])):
            before = last.get((user, kind))
            if before is None or (ts or datetime.datetime.min) - before > datetime.timedelta(minutes=60):
                want[i, user, ts, kind] += 1
                if status is None or state not in alerts.TERMINAL:
                    last[user, kind] = ts or datetime.datetime.min
        assert Counter((r["event_id"], r["user"], r["event_ts"], r["alert_type"]) for r in out.filter("fired").collect()) == want
        moves = [line for line in plan(out).splitlines() if "Exchange" in line]
        assert sum("(stretch_" in m for m in moves) == 1 and sum("(of_" in m and "day_" in m for m in moves) == 3 and len(moves) == 5
    assert all(p.count("Exchange") == 1 for p in cut_plans) and len(cut_plans) == 2  # the repartition above


def test_scored_events_are_joined_with_a_narrow_history_by_row(spark, monkeypatch):
    """Repeated and missing ids and a missing time are events of their own; the history moves and is kept without what it doesn't need."""
    held = []
    monkeypatch.setattr(history, "cut", lambda df: held.append(df.columns) or cuts.cut(df))
    day = datetime.datetime(2024, 3, 4, 9)
    told = [(1, day, "Read"), (1, day + datetime.timedelta(hours=1), "read "), (2, day + datetime.timedelta(hours=2), "Write"), (None, day + datetime.timedelta(hours=3), "Write"), (None, day + datetime.timedelta(hours=28), "Delete"), (5, None, "Read")]
    text = lambda at, action: f'{{"createdDateTime": "{at.isoformat() if at else ""}", "userPrincipalName": "u", "appDisplayName": "{action}", "resourceDisplayName": "hr/x", "location": "DE"}}'
    raw = spark.createDataFrame([(i, "azure_ad", text(at, action)) for i, at, action in told], "event_id long, source string, raw string")
    out = ingest.scored(ingest.stored(raw)).collect()
    got = sorted((r["total_events"], r["event_id"], r["action"], r["first_time_action"], r["geo_rarity"], r["events_in_window"], r["metadata"]["country"]) for r in out)
    assert got == [
        (1, 5, "Read", True, True, 1, "DE"), (2, 1, "Read", False, False, 1, "DE"), (3, 1, "read ", False, False, 2, "DE"),
        (4, 2, "Write", True, False, 3, "DE"), (5, None, "Write", False, False, 4, "DE"), (6, None, "Delete", True, False, 1, "DE"),
    ]
    assert len(held) == 1 and not {"metadata", "resource", "timestamp", "usb_events"} & set(held[0])
