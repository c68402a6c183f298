"""Ingest by keyed state, against a plain loop in order of arrival."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardspan.operators import alerts, ingest
from wardspan.streaming import arrivals, streams

RAW = "event_id long, source string, raw string, ingested_at timestamp"
BEGIN = datetime(2024, 5, 1, tzinfo=timezone.utc)
LOCAL = ("127.0.0.1", "::1", "localhost", "")


def raw_of(number, user, at, action, ip="", country=""):
    text = f'{{"createdDateTime": "{at:%Y-%m-%dT%H:%M:%SZ}", "userPrincipalName": "{user}", "appDisplayName": "{action}", "ipAddress": "{ip}", "location": {{"countryOrRegion": "{country}"}}}}'
    return number, "azure_ad", text


def made(n, seed, users=4):
    """Events as tuples (id, user, event time, action, ip, country, time of arrival); event times are in any order."""
    rng, at = random.Random(seed), BEGIN
    rows = []
    for i in range(n):
        at += timedelta(minutes=rng.choice([1, 20, 90, 400]), microseconds=i)
        ip, country = rng.choice(["10.0.0.1", "10.0.0.2", "127.0.0.1", ""]), rng.choice(["US", "de", ""])
        rows.append((i, f"u{rng.randrange(users)}", BEGIN + timedelta(minutes=rng.randrange(60 * 24 * 9)), rng.choice(["Read", " read", "Write", "Delete"]), ip, country, at))
    return rows


def loop(events, cap):
    """What each event sees of its user's earlier ones: total, three flags, and events in 24 hours."""
    seen, times, out = defaultdict(lambda: deque(maxlen=cap)), defaultdict(list), {}
    for number, user, _, action, ip, country, at in events:
        old = seen[user]
        keys = action.strip().lower(), ip.strip(), country.strip().upper()
        counts = keys[0] != "", keys[1] not in LOCAL, keys[2] != ""
        flags = [c and all(o[i] != k for o in old) for i, (k, c) in enumerate(zip(keys, counts))]
        times[user].append(at)
        out[number] = (user, len(times[user]), *flags, sum(t >= at - timedelta(hours=24) for t in times[user]))
        old.append(keys)
    return out


SHOWN = ["user", "total_events", "first_time_action", "new_ip", "geo_rarity", "events_in_window"]


def told(df):
    return {r["event_id"]: tuple(r[c] for c in SHOWN) for r in df.collect()}


def put(spark, rows, folder):
    table = [(*raw_of(n, u, t, a, ip, c), at) for n, u, t, a, ip, c, at in rows]
    spark.createDataFrame(table, RAW).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema(RAW).parquet(folder)


def state(spark, folder, variable, operator):
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(f"{folder}/state")


def test_five_batches_equal_a_loop_in_order_of_arrival(spark, tmp_path):
    """Late events, repeated deliveries within a batch and across two, and a restart for every batch."""
    rows = made(150, 1)
    want = loop(rows, 20)
    assert [want[i][1] for i in range(150) if want[i][1] == 1] == [1] * 4
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    for k in range(5):
        part = rows[30 * k : 30 * k + 30]
        put(spark, random.Random(k).sample(part, 30) + part[:5] + rows[max(0, 30 * k - 4) : 30 * k], source)
        out = streams.ingest_stream(stream_of(spark, source), kept, cap=20)
        assert told(out) == {i: want[i] for i in range(30 * k + 30)} and out.count() == 30 * k + 30
    raised = alerts.candidates(out.withColumnRenamed("total_events", "seq")).filter("alert_type = 'new_user'")
    assert sorted(r["user"] for r in raised.collect()) == ["u0", "u1", "u2", "u3"]

    # Every hour that no window can reach any more is gone, and so are keys out of the last 20.
    kept_hours = state(spark, kept, "hours", 0).select("key.user", "user_map_key.hour").collect()
    newest = max(r[6] for r in rows[:120])  # timers run with the next batch
    bound = (newest - timedelta(hours=24 + 24 + 1)).timestamp() // 3600
    assert kept_hours and all(r["hour"] >= bound for r in kept_hours) and max(len([1 for r in kept_hours if r["user"] == u]) for u in {r["user"] for r in kept_hours}) <= 50
    chunks = state(spark, kept, "chunks", 0)
    assert chunks.count() < 150 and chunks.select("user_map_key.hour").distinct().count() == len({r["hour"] for r in kept_hours})


def test_a_state_to_begin_with(spark, tmp_path):
    rows = made(120, 2)
    want = loop(rows, 15)
    old, source = str(tmp_path / "old"), str(tmp_path / "in")
    put(spark, rows[:70], old)
    put(spark, rows[70:], source)
    stored = ingest.stored(spark.read.parquet(old), ["ingested_at"])
    start = arrivals.history_state(stored, cap=15)
    out = streams.ingest_stream(stream_of(spark, source), str(tmp_path / "kept"), cap=15, start=start)
    assert told(out) == {i: want[i] for i in range(70, 120)}


def test_scores_join_before_the_state_and_deal_no_event_out_again(spark, tmp_path):
    """Users with no score, a null or several ones; events go out by their key and by user, and nothing after the state moves them."""
    rows = made(60, 4, users=5)
    want = loop(rows, 500)
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    put(spark, rows, source)
    of = {"u0": [0.1], "u1": [None], "u2": [0.5, 0.75], "u3": [float("inf")], None: [0.9]}
    scores = spark.createDataFrame([(u, s) for u, all_ in of.items() for s in all_], "user string, ae_live double")
    out = streams.ingest_stream(stream_of(spark, source), kept, scores)
    assert told(out) == want
    got = defaultdict(list)
    for r in out.collect():
        got[r["event_id"]].append(r["ae_live"])
    assert {i: sorted(s, key=str) for i, s in got.items()} == {i: of.get(want[i][0], [None]) for i in want}

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with arrivals.keyed_state(spark):
            stream = arrivals.scored(stream_of(spark, source), scores)
            query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "plan")).trigger(availableNow=True).start()
            query.awaitTermination()
            plan = query._jsq.explainInternal(False)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    after, before = plan.split("TransformWithStateInPySpark")
    assert "Exchange" not in after and before.count("Exchange hashpartitioning(user") == 2  # events, and the scores


def test_events_without_an_id_or_a_time_of_arrival(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(None, *raw_of(0, "u", BEGIN, "Read")[1:], None)] * 5 + [(7, *raw_of(7, "u", BEGIN, "Read")[1:], None)] * 3 + [(8, "nowhere", "{}", None)]
    spark.createDataFrame(rows, RAW).write.parquet(source)
    out = streams.ingest_stream(stream_of(spark, source), str(tmp_path / "kept")).collect()
    assert sorted(r["total_events"] for r in out) == [1, 2, 3, 4, 5, 6] and {r["events_in_window"] for r in out} == {1, 2, 3, 4, 5, 6}
    assert len({r["ingested_at"] for r in out}) == 1 and [r["event_id"] for r in out].count(None) == 5


def test_dedup_keeps_events_without_an_id(spark, tmp_path):
    rows = [(None, datetime(2024, 1, 1), 1)] * 5 + [(3, datetime(2024, 1, 1), 1)] * 4
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(source)
    stream = streams.event_stream(spark, source, "event_id long, ts timestamp_ntz, user_id long")
    out = streams.run_available(streams.dedup(stream)).collect()
    assert sorted(str(r["event_id"]) for r in out) == ["3"] + ["None"] * 5


def plain_alerts(events, changes):
    """Alerts by one loop over events (time, user, type, id) and changes (time, user, type, event's id, active), an event before a change of its time."""
    held, out = defaultdict(dict), []
    for at, is_change, user, kind, number, active in sorted([(a, False, u, k, n, True) for a, u, k, n in events] + [(a, True, u, k, n, x) for a, u, k, n, x in changes], key=lambda r: (r[0], r[1], r[4])):
        mine = held[user, kind]
        if is_change:
            if number in mine:
                mine[number][1] = active
        elif not any(on and at - t <= timedelta(minutes=60) for t, on in mine.values()):
            out.append((user, kind, number))
            mine[number] = [at, True]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_with_changes_of_status_between_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["new_user", "ae_critical", "rarity_spike", "anomalous_behavior"]
    fields = "event_id long, user string, ingested_at timestamp, total_events long, ae_live double, rarity double, first_time_action boolean, off_hours boolean"
    log = "user string, alert_type string, alert_id long, status string, changed_at timestamp"
    events, changes, rows, at = [], [], [], BEGIN
    for i in range(160):
        at += timedelta(minutes=rng.choice([1, 3, 25, 60, 61]))
        user, fires = f"u{rng.randrange(2)}", [k for k in kinds if rng.random() < 0.5]
        rows.append((i, user, at, 1 if "new_user" in fires else 2, 0.8 if "ae_critical" in fires else None, 0.7 if "rarity_spike" in fires else 0.1, *["anomalous_behavior" in fires] * 2))
        events += [(at, user, k, i) for k in fires]
        for k in fires:
            if rng.random() < 0.6:
                status = rng.choice(alerts.STATUSES)
                changes.append((at + timedelta(minutes=rng.choice([0, 2, 30, 200])), user, k, i, status))
    scored, changed = str(tmp_path / "scored"), str(tmp_path / "changed")
    number = {(k, i): n for k, i, n in spark.createDataFrame([(u, k, i) for _, u, k, i in events], "user string, alert_type string, event_id long").select("alert_type", "event_id", F.xxhash64("user", "alert_type", "event_id")).collect()}
    for b in range(4):
        ends = rows[40 * b][2], rows[40 * b + 40][2] if b < 3 else BEGIN + timedelta(days=9999)
        spark.createDataFrame(rows[40 * b : 40 * b + 40], fields).repartition(3).write.mode("append").parquet(scored)
        now = [(u, k, number[k, i], s, a) for a, u, k, i, s in changes if (ends[0] <= a or b == 0) and a < ends[1]]
        spark.createDataFrame(now, log).coalesce(1).write.mode("append").parquet(changed)
        with arrivals.keyed_state(spark):
            found = streams.run_available(arrivals.fired(spark.readStream.schema(fields).parquet(scored), spark.readStream.schema(log).parquet(changed)), folder=str(tmp_path / "kept"))
    want = plain_alerts(events, [(a, u, k, i, s in alerts.STATUSES[:2]) for a, u, k, i, s in changes])
    assert sorted((r["user"], r["alert_type"], r["event_id"]) for r in found.collect()) == want and {k for _, k, _ in want} == set(kinds)
    left = state(spark, str(tmp_path / "kept"), "alerts", 0)
    assert left.count() < len(want) and found.filter(F.col("created_at").isNull()).count() == 0


def test_settings_come_back(spark):
    before = [spark.conf.get(k, None) for k in arrivals.SETTINGS]
    with arrivals.keyed_state(spark):
        assert [spark.conf.get(k) for k in arrivals.SETTINGS] == list(arrivals.SETTINGS.values())
    assert [spark.conf.get(k, None) for k in arrivals.SETTINGS] == before
