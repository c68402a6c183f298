import pytest
from pyspark.sql import functions as F

from wardspan.operators import cases, catalog


@pytest.fixture(scope="module")
def users(spark):
    batch = spark.createDataFrame([(f"USR{i:03d}", 0.1 + 0.9 * i / 24) for i in range(25)], "user string, score double")
    live = spark.createDataFrame([("USR001", 0.99), ("cloud-a", 0.8), ("cloud-b", 0.5), ("cloud-c", 0.1)], "user string, score double")
    return catalog.all_users(batch, live, 0.9, 0.7)


def test_pages_do_not_overlap_and_are_sorted(users):
    first = [r["user"] for r in catalog.list_users(users, limit=10).collect()]
    second = [r["user"] for r in catalog.list_users(users, limit=10, offset=10).collect()]
    whole = [tuple(r[c] for c in ("tier", "score")) for r in catalog.list_users(users, limit=5000).collect()]
    assert not set(first) & set(second) and len(whole) == 28
    assert whole == sorted(whole, key=lambda r: (catalog.TIERS.index(r[0]), -r[1]))


def test_live_rows_of_batch_users_are_left_out(users):
    cloud = {r["user"]: r["tier"] for r in catalog.list_users(users, source="cloud").collect()}
    assert cloud == {"cloud-a": "High", "cloud-b": "Medium", "cloud-c": "Low"}


def test_filters_and_bad_values(users):
    assert {r["user"] for r in catalog.list_users(users, q=" CLOUD ").collect()} == {"cloud-a", "cloud-b", "cloud-c"}
    for bad in ({"risk": "Extreme"}, {"source": "moon"}, {"limit": 5001}, {"offset": -1}):
        with pytest.raises(ValueError):
            catalog.list_users(users, **bad)


def test_tiers_sum_to_the_total(users):
    s = catalog.stats(users).first()
    assert s["high"] + s["medium"] + s["low"] == s["total"] == 28


def test_detail_and_reason(spark, users):
    long = spark.createDataFrame([("USR024", "a", 3.0), ("USR024", "b", -4.0), ("USR024", "c", 1.0), ("USR000", "a", 1.0)], "user string, feature string, value double")
    top = catalog.user_detail(users, long, "USR024").first()
    assert [f["feature"] for f in top["features"]] == ["b", "a", "c"] and top["reason"] == "Flagged: a (37.5%); c (12.5%)"
    assert catalog.user_detail(users, long, "USR000").first()["reason"].startswith("No significant anomaly")
    assert catalog.user_detail(users, long, "nobody").count() == 0
    assert catalog.live_score(users, "nobody").first()["score"] is None


def test_sample_keeps_every_tier(users):
    got = catalog.stratified_sample(users, 10)
    assert 8 <= got.count() <= 12 and got.select("tier").distinct().count() == 3


def test_records_fold_a_log(spark):
    log = spark.createDataFrame([("u", 1, "Pending", "x", "a"), ("u", 3, "Confirmed", "y", "c"), ("u", 2, "Under Review", "x", "b"), ("v", 1, "Pending", "x", "")], "user string, saved_at int, status string, analyst string, note string")
    got = {r["user"]: r for r in cases.records(log).collect()}
    assert (got["u"]["status"], got["u"]["analyst"], got["u"]["created_at"], got["u"]["updated_at"]) == ("Confirmed", "y", 1, 3)
    assert [h["note"] for h in got["u"]["history"]] == ["b", "c"] and got["v"]["history"] == []
    told = cases.with_suggestions(cases.records(log), spark.createDataFrame([("w", "look"), ("v", "wait")], "user string, suggestion string"))
    assert {r["user"]: (r["status"], r["suggestion"]) for r in told.collect()} == {"u": ("Confirmed", None), "v": ("Pending", "wait"), "w": ("Pending", "look")}
    with pytest.raises(ValueError):
        cases.list_cases(cases.records(log), "Odd")
    assert cases.without_user(log, "u").count() == 1 and log.filter(F.col("user") == "u").count() == 3
