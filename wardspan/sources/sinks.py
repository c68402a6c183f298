"""Sinks: files, keyed upserts, deletes, metrics."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.sources.store import Store


def append_events(df: DataFrame, path: str) -> None:
    """Appends to an event table partitioned by day, so that windows read their days only."""
    df.withColumn("event_date", F.to_date("event_ts")).write.mode("append").partitionBy("event_date").parquet(path)


def event_store(spark: SparkSession, path: str, buckets: int = 256) -> Store:
    """An event table in buckets by user, so that one user's events are one bucket's files, sorted by user and time of ingest."""
    return Store(spark, path, ["user", "ingested_at"], by=["user"], buckets=buckets)


def sorted_csv(df: DataFrame, path: str, score: str = "score") -> None:
    """One CSV file, highest score first; for reports, whose rows are few."""
    df.orderBy(F.desc(score), *[c for c in df.columns if c != score]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def alert_table(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """An alert table in buckets by id; an alert's newest row counts."""
    return Store(spark, path, ["alert_id"], ["updated_at"], buckets=buckets)


def seed_live_scores(spark: SparkSession, path: str, scores: DataFrame, at) -> None:
    """Puts scores made offline (user, ae_live, rule_live, rarity, event_count) into the table of live scores as of a time."""
    upsert(spark, path, scores.withColumn("updated_at", F.lit(at)), ["user"], ["updated_at"])


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
    """Puts the newest row of each key into the table at path (store.Store), beside the old ones of its bucket."""
    Store(spark, path, keys, order).upsert(rows)


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The newest version of such a table, None if there is none."""
    return Store(spark, path, keys, order).read()


def merge_metrics(path: str, block: str, metrics: dict) -> None:
    """Sets one named block of a small JSON report on the driver and keeps the others."""
    old = {}
    if os.path.exists(path):
        with open(path) as f:
            old = json.load(f)
    with open(f"{path}.new", "w") as f:
        json.dump(old | {block: metrics}, f, indent=2)
    os.replace(f"{path}.new", path)
