import os

import pytest
from pyspark.sql import functions as F

from wardspan.sources import sinks, store
from wardspan.sources.store import Store


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def told(df):
    return {r["user"]: r["score"] for r in df.collect()}


def scores(spark, n, add=0):
    return spark.range(n).select(F.concat(F.lit("u"), "id").alias("user"), F.lit(1 + add).alias("at"), (F.col("id") * 1.0 + add).alias("score"))


def test_ten_rows_into_a_hundred_thousand(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ["user"], ["at"], buckets=32)
    assert s.read() is None and s.read_key(user="u1") is None
    s.upsert(scores(spark, 100_000))
    before = files(tmp_path)
    s.upsert(scores(spark, 10, add=1))
    after = files(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before  # no file is written again
    assert 1 <= len({f.split("bucket_=")[1].split("/")[0] for f in set(after) - set(before)}) <= 10
    got = told(s.read())
    assert len(got) == 100_000 and all(got[f"u{i}"] == i + 1.0 for i in range(10)) and got["u10"] == 10.0
    one = s.read_key(user="u3")
    assert told(one) == {"u3": 4.0} and 0 < len(one.inputFiles()) < len(after) / 8 and len({f.split("bucket_=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    s.delete_key(user="u3")
    assert s.read_key(user="u3").count() == 0 and s.read().count() == 99_999
    assert sum(f not in after for f in files(tmp_path)) <= 2
    s.delete(spark.createDataFrame([("u5",), ("u6",), ("nobody",), (None,)], "user string"))
    assert s.read().count() == 99_997
    s.purge()
    assert s.read().count() == 0 and s.read().columns == ["user", "at", "score"]


def test_a_broken_write_shows_the_old_version(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "t"), ["user"], ["at"], buckets=4)
    s.upsert(scores(spark, 20))
    want = told(s.read())
    monkeypatch.setattr(Store, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        s.upsert(scores(spark, 20, add=5))
    monkeypatch.undo()
    assert told(s.read()) == want
    s.upsert(scores(spark, 5, add=7))  # over what the broken one left
    assert told(s.read()) == want | {f"u{i}": i + 7.0 for i in range(5)}
    fresh = Store(spark, str(tmp_path / "t"), ["user"], ["at"])  # the number of buckets is the table's
    assert told(fresh.read_key(user="u4")) == {"u4": 11.0}
    old = s.manifest()
    monkeypatch.setattr(Store, "manifest", lambda self: store.Manifest(old.version - 1, 4, old.schema))  # another writer was faster
    with pytest.raises(RuntimeError):
        s.upsert(scores(spark, 1))
    monkeypatch.undo()
    assert len(told(s.read())) == 20


def test_many_small_writes_become_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTS", 3)
    s = Store(spark, str(tmp_path / "t"), ["user"], ["at"], buckets=2)
    want = {}
    for i in range(9):
        s.upsert(scores(spark, 4, add=i if i != 5 else -1))  # the sixth is older than all
        want |= {f"u{k}": k + float(i) for k in range(4)} if i != 5 else {}
        assert told(s.read()) == want and max(map(len, s.manifest().parts.values())) <= 3
    assert len([d for d in os.listdir(tmp_path / "t") if d.startswith("v=")]) <= 6


def test_new_columns_and_null_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ["user"], ["at"], buckets=3)
    s.upsert(spark.createDataFrame([(None, 1, 1.0), ("b", 1, 2.0)], "user string, at int, score double"))
    s.upsert(spark.createDataFrame([(None, 2, 3.0, "x")], "user string, at int, score double, note string"))
    assert sorted(((r["user"] or ""), r["score"], r["note"]) for r in s.read().collect()) == [("", 3.0, "x"), ("b", 2.0, None)]
    assert told(s.read_key(user=None)) == {None: 3.0}


def test_events_of_a_user_read_one_bucket(spark, small, tmp_path):
    from wardspan.operators import catalog
    from wardspan.sources.tables import events

    s = sinks.event_store(spark, str(tmp_path / "e"), buckets=16)
    e = events(spark, small).withColumn("ingested_at", F.col("event_ts") + F.expr("INTERVAL 1 HOUR"))
    half = F.col("event_id") % 2 == 0
    s.write(e.filter(half))
    s.write(e.filter(~half))
    assert s.read().count() == e.count()
    user = e.groupBy("user").count().orderBy(F.desc("count"), "user").first()["user"]
    mine = s.read_key(user=user)
    assert mine.count() == e.filter(F.col("user") == user).count()
    assert len({f.split("bucket_=")[1].split("/")[0] for f in mine.inputFiles()}) == 1 and len(mine.inputFiles()) < len(s.read().inputFiles())
    plan = catalog.user_events(mine, user)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex" in plan and len({p.split("/")[0] for p in plan.split("bucket_=")[1:]}) <= 2
    now = e.agg(F.max("ingested_at")).first()[0]
    got = catalog.recent_events(mine, user, now, 24).collect()
    want = [r for r in e.filter(F.col("user") == user).collect() if (now - r["ingested_at"]).total_seconds() <= 86400]
    assert [r["event_id"] for r in got] == [r["event_id"] for r in sorted(want, key=lambda r: (r["ingested_at"], r["event_id"]), reverse=True)]
