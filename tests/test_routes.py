"""Route results over more users than a page holds."""

from datetime import datetime

from wardspan.plans import routes


def test_search_gives_every_user_that_matches(spark, tmp_path):
    rows = [(4 * i + j, datetime(2024, 1, 1, 12, j), 10_000 + i, "view", 1.0, '{"k": 1}') for i in range(5_100) for j in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = routes.user_search(spark, str(tmp_path))
    assert found.count() == 5_100 and found.select("user").distinct().count() == 5_100
