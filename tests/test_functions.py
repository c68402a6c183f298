import datetime

import pytest
from pyspark.sql import functions as F

from wardspan.functions import texts, times
from wardspan.operators import alerts, history


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zoned(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_parsed_times_are_utc_in_any_session(zoned):
    cases = [
        ("2026-01-02T01:00:00Z", "2026-01-02 01:00:00"), ("2026-01-02T08:00Z", "2026-01-02 08:00:00"), ("2026-01-02T08:00", "2026-01-02 08:00:00"), ("2026-01-02 08", "2026-01-02 08:00:00"),
        ("2026-01-02T01:00:00.25+05:30", "2026-01-01 19:30:00.25"), ("2026-03-08T02:30:00", "2026-03-08 02:30:00"), ("2026-01-02T23:00:00-0330", "2026-01-03 02:30:00"),
        ("2026-02-30", None), ("2026-01-02T25:00:00Z", None), ("x", None), (None, None), ("2026-01-02", "2026-01-02 00:00:00"), ("2026-01-02T01:00:00.123456789+05", "2026-01-01 20:00:00.123456"),
    ]
    df = zoned.createDataFrame(cases, "t string, want string")
    got = df.select("t", "want", times.parse_iso(F.col("t")).cast("string").alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == cases
    month_first = zoned.createDataFrame([("01/02/2010 06:49:00",), ("13/02/2010 06:49:00",)], "t string")
    assert [r[0] for r in month_first.select(times.parse_any(F.col("t")).cast("string")).collect()] == ["2010-01-02 06:49:00", None]
    late = zoned.createDataFrame([("2026-01-02T10:00:00Z",), ("2026-01-02T19:30:00Z",), ("2026-01-03T10:00:00Z",)], "t string")
    assert [r[0] for r in late.select(times.off_hours(times.parse_iso(F.col("t")))).collect()] == [False, True, True]


def test_hours_pass_alike_in_any_session(zoned):
    """Windows and quiet times across the hours that clocks change."""
    at = [datetime.datetime(2026, 3, 8, 1, 30) + datetime.timedelta(minutes=30 * i) for i in range(8)]
    df = zoned.createDataFrame([(i, "u", t) for i, t in enumerate(at)], "event_id int, user string, event_ts timestamp_ntz")
    assert [r["events_in_window"] for r in history.rolling(df, [], 1).orderBy("event_id").collect()] == [1, 2, 3, 3, 3, 3, 3, 3]
    fired = alerts.suppress(df.withColumn("alert_type", F.lit("a"))).filter("fired").orderBy("event_id").collect()
    assert [r["event_id"] for r in fired] == [0, 3, 6]
    micros = df.select(times.micros(df, "event_ts")).collect()
    assert [r[0] for r in micros] == [int((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1)) for t in at]
    back = df.select(F.timestamp_micros(times.micros(df, "event_ts")).alias("t")).select(times.utc_clock(F.col("t")))
    assert [r[0] for r in back.collect()] == at


def test_times(spark):
    cases = [
        ("2026-01-02T01:00:00+05:00", "2026-01-01", False), ("2024-01-06T12:00:00Z", "2024-01-06", False), ("2024-01-02 19:00:00", "2024-01-02", True),
        ("2024-01-02", "2024-01-02", True), ("2026/05/09", None, False), ("", None, False), (None, None, False), ("2024-01-02Tjunk", "2024-01-02", False),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = df.select("t", times.utc_day(F.col("t")).cast("string").alias("d"), times.after_hours_live(F.col("t")).alias("l")).collect()
    assert [(r["t"], r["d"], r["l"]) for r in got] == [(t, d, late or t == "2026-01-02T01:00:00+05:00") for t, d, late in cases]


def test_off_hours(spark):
    df = spark.createDataFrame([("2024-01-05 18:59:59",), ("2024-01-05 19:00:00",), ("2024-01-06 12:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r[0] for r in df.select(times.off_hours(F.col("t"))).collect()] == [False, True, True, False]


def test_texts(spark):
    df = spark.createDataFrame([("x.tar.gz", "a@B.example", "12"), ("none", "plain", "x.txt"), (None, None, None)], "f string, m string, n string")
    got = df.select(texts.extension(F.col("f")), texts.domain_after_last(F.col("m")), texts.number_or_zero(F.col("n"))).collect()
    assert [tuple(r) for r in got[:2]] == [("gz", "b.example", 12), ("", "", 0)]
    assert got[2][2] == 0


def test_cloud_user(spark):
    rows = [("n", None, None, "IAMUser"), (None, "iss", None, "AssumedRole"), (None, None, "R:secmonkey", "AssumedRole"), (None, None, "R:12345", "AssumedRole"), ("", "", "", "Root")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert [r[0] for r in df.select(texts.cloud_user(*map(F.col, "abcd"))).collect()] == ["n", "iss", "secmonkey", "AssumedRole", "Root"]
