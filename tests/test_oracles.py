"""A few queries of each kind against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from wardspan.plans import registry

NAMES = [
    "cloud_user_day", "cloud_user_day_new_actions", "normalize_events", "time_columns", "daily_activity", "rarity_flags", "rolling_24h_features", "high_volume_1h",
    "batch_rule_score", "f1_optimal_threshold", "auroc", "average_precision", "flagged_shares", "alert_suppression", "case_history", "canonical_user", "interval_label_days", "file_extension",
    "ingest_stream", "alert_status_stream", "alert_table", "events_by_ingest", "peer_context", "live_user_vector", "mixed_json", "trail_csv", "case_store", "live_upserts", "access_events", "time_texts",
    "user_search", "live_score_lookup", "users_by_events", "top_user_detail",
]


def rows_of(columns, rows):
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in expected.description]
    df = registry.QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, expected.fetchall())
