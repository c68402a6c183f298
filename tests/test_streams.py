import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardspan.plans import streams as P
from wardspan.streaming import streams


@pytest.fixture(scope="module")
def shuffled(small, tmp_path_factory):
    """The events in 20 part files by time, the newest first in the stream."""
    top = tmp_path_factory.mktemp("shuffled")
    (top / "events.parquet").mkdir()
    rows = pq.read_table(f"{small}/events.parquet").sort_by("ts")
    size = -(-len(rows) // 20)
    for i in range(20):
        path = top / "events.parquet" / f"part-{19 - i:05}.parquet"
        pq.write_table(rows.slice(i * size, size), path)
        os.utime(path, (1_700_000_000 - 60 * i,) * 2)
    return str(top)


@pytest.mark.parametrize("query", [P.dedup_stream, P.tumbling_stream, P.rolling_stream, P.alert_stream])
def test_files_in_any_order_of_time(spark, small, shuffled, query):
    rows = lambda sf: sorted(tuple(map(str, r)) for r in query(spark, sf).collect())
    whole = rows(small)
    assert whole and rows(shuffled) == whole


def test_ingest_goes_on_after_a_restart_and_drops_repeated_ids(spark, tmp_path, small):
    from wardspan.operators import ingest
    from wardspan.plans.ingesting import ae_live, raw_events
    from wardspan.sources.tables import events, table, view

    rows = table(spark, small, "events").orderBy("ts", "event_id").limit(300)
    whole = ingest.scored(ingest.stored(raw_events(view(rows))), ae_live(events(spark, small)))
    shown = ["event_id", "user", "total_events", "events_in_window", "rule_live", "ae_live", "flags_fired", "rarity"]
    want = sorted(tuple(r) for r in whole.select(*shown).collect())
    first = rows.orderBy("ts", "event_id").limit(150)
    parts = [first, rows.join(first.select("event_id"), "event_id", "left_anti").select(rows.columns).unionByName(first.limit(20))]
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    told = lambda: raw_events(view(streams.event_stream(spark, source).withColumn("ingested_at", F.col("event_ts")), ["ingested_at"]), ["ingested_at"])
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        out = streams.ingest_stream(told(), kept, ae_live(events(spark, small)))
        assert out.count() == (150, 300)[k]
    assert sorted(tuple(r) for r in out.select(*shown).collect()) == want
    again = streams.ingest_stream(told(), kept)
    assert again.count() == 300


def test_events_without_a_time_or_an_object(spark):
    from wardspan.operators import ingest

    rows = [(1, "cert_http", '{"user": "u", "date": "01/02/2010 03:04:05", "url": "x"}'), (2, "cert_http", '{"user": "u", "date": "never"}'), (3, "nowhere", "{}"), (None, "cert_http", '{"user": "u", "date": "2010-01-02T03:04Z"}')]
    out = ingest.scored(ingest.stored(spark.createDataFrame(rows, "event_id long, source string, raw string")))
    got = sorted((r["event_id"] or 0, r["total_events"], r["events_in_window"], r["off_hours"], r["ae_live"]) for r in out.collect())
    assert got == [(0, 2, 1, True, None), (1, 3, 2, True, None), (2, 1, 1, False, None)]
    fired = ingest.fired(out).collect()
    assert [(r["event_id"], r["alert_type"]) for r in fired if r["alert_type"] == "new_user"] == [(2, "new_user")]
    assert {r["event_count"] for r in ingest.live_scores(out).collect()} == {3}


def test_replays(spark):
    from wardspan.operators import ingest

    rows = [(i, "cert_http", f'{{"user": "u{i}", "date": "01/0{9 - i}/2010 03:04:05"}}') for i in range(5)] + [(7, "cert_http", "{"), (8, "nowhere", "{}"), (9, None, "{}")]
    raw = spark.createDataFrame(rows, "event_id long, source string, raw string")
    assert sorted((str(r["source"]), r["events"], r["rejected"]) for r in ingest.dry_run(raw).collect()) == [("None", 0, 1), ("cert_http", 5, 1), ("nowhere", 0, 1)]
    assert sorted((r["event_id"], r["user"]) for r in ingest.replay(raw, "me", 2).collect()) == [(3, "me"), (4, "me")]
    assert ingest.replay(raw).count() == 5


@pytest.mark.parametrize("part", ["metadata", "offsets", "commits"])
def test_a_corrupt_checkpoint_begins_again(spark, tmp_path, part):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
        assert streams.run_available(stream(), folder=kept).count() == 10 * k + 10
    path = tmp_path / "kept" / "state" / part
    newest = path if path.is_file() else max(path.glob("[0-9]*"), key=lambda p: int(p.name))
    newest.write_text("v1\n{broken" if part != "metadata" else "{")
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert not streams.is_sound(spark, f"{kept}/state")
    assert sorted(r["id"] for r in streams.run_available(stream(), folder=kept).collect()) == list(range(20))
    assert streams.is_sound(spark, f"{kept}/state") and len(list((tmp_path / "kept").glob("broken-*/state"))) == 1


def test_the_state_of_hopping_windows_are_hours(spark, small):
    from wardspan.sources.tables import table

    hours = streams.run_available(streams.hourly_counts(streams.event_stream(spark, f"{small}/events.parquet", files_per_batch=None)), "update")
    want = table(spark, small, "events").select("user_id", F.date_trunc("hour", "ts")).distinct().count()
    assert hours.count() == want
    whole = streams.run_available(streams.hopping(streams.event_stream(spark, f"{small}/events.parquet", files_per_batch=None)), "update").drop("batch_")
    assert sorted(map(tuple, streams.hopped(hours).collect())) == sorted(map(tuple, whole.collect()))
