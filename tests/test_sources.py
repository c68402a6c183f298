import gzip
import json

from wardspan.sources import readers, sinks


def test_json_shapes(spark, tmp_path):
    events = [{"eventName": "a"}, {"eventName": "b"}]
    (tmp_path / "e.json").write_text(json.dumps({"Records": events}))
    (tmp_path / "l.json").write_text(json.dumps(events))
    (tmp_path / "n.jsonl").write_text("\n".join([*map(json.dumps, events), "{broken", ""]))
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        json.dump({"Records": events}, f)
    for name in ("e.json", "l.json", "n.jsonl", "g.json.gz"):
        raws = sorted(json.loads(r["raw"])["eventName"] for r in readers.any_events(spark, str(tmp_path / name)).collect())
        assert raws == ["a", "b"], name


def test_trail_csv_takes_known_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Event Time,Event Name,User Name,Source IP\n2024-01-01T00:00:00Z,Get,bob,1.2.3.4\n,NoTime,x,y\n")
    rows = [json.loads(r["raw"]) for r in readers.any_events(spark, str(tmp_path / "t.csv")).collect()]
    assert len(rows) == 1 and rows[0]["userIdentity"]["userName"] == "bob" and rows[0]["awsRegion"] == readers.DEFAULT_REGION


def test_cert_csv_prunes_and_filters(spark, tmp_path):
    (tmp_path / "logon.csv").write_text("id,date,user,pc,activity\n1,01/02/2024 03:04:05,U1,P,Logon\n2,01/02/2024 03:04:05,U2,P,Logoff\n")
    cohort = spark.createDataFrame([("U1",)], "user string")
    got = readers.cert_csv(spark, str(tmp_path / "logon.csv"), "logon", ["user", "activity"], cohort).collect()
    assert [tuple(r) for r in got] == [("U1", "Logon")]


def test_upsert_delete_and_purge(spark, tmp_path):
    path = str(tmp_path / "live")
    rows = lambda *r: spark.createDataFrame(r, "user string, at int, score double")
    sinks.upsert(spark, path, rows(("a", 1, 0.1), ("b", 1, 0.2)), ["user"], ["at"])
    sinks.upsert(spark, path, rows(("a", 2, 0.9)), ["user"], ["at"])
    sinks.upsert(spark, path, rows(("b", 0, 0.7)), ["user"], ["at"])  # older than what is there
    assert {r["user"]: r["score"] for r in sinks.current(spark, path, ["user"], ["at"]).collect()} == {"a": 0.9, "b": 0.2}


def test_metrics_keep_other_blocks(tmp_path):
    path = str(tmp_path / "m.json")
    sinks.merge_metrics(path, "a", {"x": 1})
    sinks.merge_metrics(path, "b", {"y": 2})
    assert json.load(open(path)) == {"a": {"x": 1}, "b": {"y": 2}}


def test_folder_of_mixed_files(spark, tmp_path):
    import gzip

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text('{"Records": [{"eventName": "A"}, {"eventName": "B"}]}')
    (tmp_path / "in" / "deep" / "b.jsonl").write_text('{"eventName": "C"}\nbroken\n')
    (tmp_path / "in" / "deep" / "c.csv").write_text("Event Time,Event Name\n2024-01-01,D\n,E\n")
    with gzip.open(tmp_path / "in" / "d.json.gz", "wt") as f:
        f.write('[{"eventName": "F"}]')
    (tmp_path / "in" / "note.txt").write_text("{}")
    raw = readers.any_events(spark, str(tmp_path / "in"))
    assert sorted(r[0] for r in raw.selectExpr("get_json_object(raw, '$.eventName')").collect()) == ["A", "B", "C", "D", "F"]


def test_case_store_and_log(spark, tmp_path):
    import pytest

    from wardspan.operators import cases

    (tmp_path / "store.json").write_text('{"u": {"status": "Pending", "notes": "n", "history": [{"status": "Cleared", "note": "x"}]}, "v": {"status": "Cleared", "history": "[]"}}')
    got = {r["user"]: (r["status"], r["analyst"], r["notes"], len(r["history"])) for r in cases.store_of(spark, str(tmp_path / "store.json")).collect()}
    assert got == {"u": ("Pending", "", "n", 1), "v": ("Cleared", "", "", 0)}
    log = spark.createDataFrame([("u", 1, "Pending", "a", ""), ("u", 2, "Confirmed", "b", "y")], "user string, saved_at int, status string, analyst string, note string")
    for saved_at in (1, 2):
        cases.save(spark, str(tmp_path / "log"), log.filter(f"saved_at = {saved_at}"))
    assert cases.get(cases.records(cases.load(spark, str(tmp_path / "log"))), "u").first()["status"] == "Confirmed"
    with pytest.raises(ValueError):
        cases.save(spark, str(tmp_path / "log"), log.selectExpr("user", "saved_at", "'odd' AS status", "analyst", "note"))


def test_events_by_actor_and_missing_columns(spark):
    df = spark.createDataFrame([('{"actor": {"login": "g"}, "created_at": "2"}',), ('{"actor": {"display_login": "g"}, "created_at": "1"}',), ('{"type": "x"}',), ("broken",)], "raw string")
    assert [(r["user"], r["timestamp"]) for r in readers.events_by_actor(df).collect()] == [("g", "1"), ("g", "2")]
    scores = spark.createDataFrame([("u", 1.0)], "user string, score double")
    joined, missing = readers.scores_with_attribution(scores, spark.createDataFrame([("u", 2.0)], "user string, f double"), ["score", "label"])
    assert joined.columns == ["user", "score", "f"] and missing == ["label"]
