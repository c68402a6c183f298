"""Ingest: raw events to scored events and alerts, as one plan for a batch or for each batch of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions import times as T
from wardspan.operators import alerts, features, history, normalize, scoring
from wardspan.operators.cuts import cut

#: Columns of a stored event.
STORED = ["event_id", *normalize.FIELDS, "event_ts", "country"]


def stored(raw: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Normalised events (STORED, and other columns of raw) of raw ones (event_id, source, raw); rejects() of the normaliser has the others."""
    good = normalize.normalize(raw)
    return good.withColumns({"event_ts": T.parse_any(F.col("timestamp")), "country": F.coalesce(F.col("metadata")["country"], F.lit(""))}).select(*STORED, *(also or []))


def replay(raw: DataFrame, user: str | None = None, limit: int | None = None) -> DataFrame:
    """What a replay of raw events would store: the first ``limit`` of them by time, then id, all of one user if told; rejects don't count."""
    out = stored(raw)
    if limit is not None:
        out = out.orderBy(F.col("event_ts").asc_nulls_last(), "event_id").limit(limit)
    return out if user is None else out.withColumn("user", F.lit(user))


def dry_run(raw: DataFrame) -> DataFrame:
    """What a replay would do, without storing anything: source, events and rejected."""
    good = normalize.valid(raw)
    return raw.groupBy("source").agg(F.count_if(good).alias("events"), F.count_if(~good).alias("rejected"))


def scored(events: DataFrame, ae_live: DataFrame | None = None, rule: dict[str, tuple[float, int]] = scoring.LIVE_RULE, cap: int | None = history.CAP, hours: int = 24) -> DataFrame:
    """Stored events with their features, total_events, flags and rarity, sums over the last hours, rule_live and ae_live.

    An event's history are the user's events of earlier time (of one time, of
    smaller id), so its own values never count as seen. Events without a time
    come first, and are in one window by themselves. ae_live (user, ae_live) is
    the model's score, null for users without one. Repeated ids are events of
    their own here: drop them before where ids are native.
    """
    # The rows are numbered, as ids may repeat, so that the history of an event can be joined to it without moving the other columns before.
    events = cut(events.withColumn("row_", F.monotonically_increasing_id()))
    out = history.rarity_flags(history.event_flags(features.event_features(events)), cap, events).withColumnRenamed("seq", "total_events").drop("row_")
    out = history.rolling(out, list(rule), hours)
    out = out.withColumn("rule_live", scoring.live_rule({f"{c}_in_window": v for c, v in rule.items()}))
    if ae_live is None:
        return out.withColumn("ae_live", F.lit(None).cast("double"))
    return out.join(ae_live.select("user", F.col("ae_live").cast("double").alias("ae_live")), "user", "left")


def fired(events: DataFrame, status: Column | None = None) -> DataFrame:
    """Alerts (user, event_id, event_ts, alert_type, severity) of scored(), one per user, type and hour.

    status is an alert's state by the event's columns, if alerts are stored
    already: resolved ones suppress none after them.
    """
    raised = alerts.candidates(events.withColumnRenamed("total_events", "seq"))
    if status is not None:
        raised = raised.withColumn("status", status)
    return alerts.suppress(raised, status=None if status is None else "status").filter("fired").drop("fired")


def live_scores(events: DataFrame) -> DataFrame:
    """A row per user of scored(): the newest event's ae_live (0 if absent), rule_live and rarity, and event_count; what an upsert stores."""
    newest = F.max(F.struct("total_events", F.coalesce("ae_live", F.lit(0.0)).alias("ae_live"), "rule_live", "rarity")).alias("l")
    return events.groupBy("user").agg(newest).select("user", "l.ae_live", "l.rule_live", "l.rarity", F.col("l.total_events").alias("event_count"))
