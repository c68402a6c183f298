"""Alert rules, suppression, states and rebuilds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.functions.times import micros
from wardspan.operators.cuts import cut, join_summary
from wardspan.sources.store import Store

STATUSES = ["Open", "Acknowledged", "Resolved", "False Positive"]
TERMINAL = ["Resolved", "False Positive"]
QUIET_MINUTES = 60


def rules(total: Column, encoder: Column, rarity: Column, first_time: Column, off_hours: Column) -> Column:
    """The alerts (alert_type, severity) that an event raises, as an array."""
    alert = lambda kind, severity: F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity"))
    return F.filter(
        F.array(
            F.when(total == 1, alert("new_user", F.lit("Low"))),
            F.when(encoder >= 0.5, alert("ae_critical", F.when(encoder >= 0.7, "Critical").otherwise("High"))),
            F.when(rarity >= 0.6, alert("rarity_spike", F.when(rarity >= 0.8, "Critical").otherwise("High"))),
            F.when(first_time & off_hours, alert("anomalous_behavior", F.lit("High"))),
        ),
        lambda a: a.isNotNull(),
    )


def candidates(df: DataFrame) -> DataFrame:
    """A row per alert of scored events (user, event_ts, event_id, seq, rarity, first_time_action, off_hours; ae_live if there)."""
    encoder = F.col("ae_live") if "ae_live" in df.columns else F.lit(None).cast("double")
    raised = rules(F.col("seq"), encoder, F.col("rarity"), F.col("first_time_action"), F.col("off_hours"))
    return df.select("user", "event_id", "event_ts", F.explode(raised).alias("a")).select("user", "event_id", "event_ts", "a.alert_type", "a.severity")


def suppress(df: DataFrame, minutes: int = QUIET_MINUTES, keys: tuple[str, ...] = ("user", "alert_type"), ts: str = "event_ts", tie: str = "event_id", status: str | None = None) -> DataFrame:
    """fired: alerts that no fired alert of the same keys precedes by up to some minutes; suppressed ones don't count.

    With a status column, a fired alert in a terminal state suppresses none after
    it. Rows of null keys are alerts of one key; a null time precedes all others.

    A gap over the limit starts a stretch, and its first alert always fires. Gaps
    are marked by key and day; a row for each day, with its first and last time
    and its gaps, tells the number of the stretch in which the day begins. So a
    busy key is dealt over its days, then over its stretches. A stretch is one
    pass in order that keeps a single time and steps from alert to alert.
    """
    limit = minutes * 60_000_000
    at = F.coalesce(micros(df, ts), F.lit(-(1 << 62)))
    others = [c for c in df.columns if c not in keys]
    marked = cut(df.withColumn("at_", at).select(F.struct(*keys).alias("of_"), F.floor(F.col("at_") / 86_400_000_000).alias("day_"), "at_", *others))
    within = W.partitionBy("of_", "day_").orderBy("at_")
    gap = F.coalesce(F.col("at_") - F.lag("at_").over(within) > limit, F.lit(False)).cast("long")
    # Rows of one time are peers of the running sum, so they are in one stretch whatever their order.
    counted = lambda rows: rows.withColumn("gap_", gap).withColumn("gaps_", F.sum("gap_").over(within)).drop("gap_")
    days = counted(marked.select("of_", "day_", "at_")).groupBy("of_", "day_").agg(F.min("at_").alias("first_"), F.max("at_").alias("end_"), F.max("gaps_").alias("gaps_"))
    by_day = W.partitionBy("of_").orderBy("day_")
    starts = F.coalesce(F.col("first_") - F.lag("end_").over(by_day) > limit, F.lit(True)).cast("long")
    days = days.withColumn("starts_", starts).select("of_", "day_", (F.sum(F.col("starts_") + F.col("gaps_")).over(by_day) - F.col("gaps_")).alias("number_"))
    marked = join_summary(counted(marked), days, ["of_", "day_"], dealt=True).withColumn("stretch_", F.xxhash64("of_", F.col("number_") + F.col("gaps_")))
    active = F.lit(True) if status is None else ~F.coalesce(F.col(status).isin(TERMINAL), F.lit(False))
    dealt = marked.select(*[F.col(f"of_.`{c}`" if c in keys else f"`{c}`").alias(c) for c in df.columns], "stretch_").repartition("stretch_")
    ordered = dealt.withColumns({"at_": at, "active_": active}).sortWithinPartitions("stretch_", "at_", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            stretch, at, active = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("stretch_", "at_", "active_"))
            begins = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
            fired = np.zeros(len(at), bool)
            for i, end in zip(begins, np.append(begins[1:], len(at))):
                if stretch[i] != open_:
                    open_, last = stretch[i], None
                elif last is not None:
                    i += np.searchsorted(at[i:end], last + limit, "right")
                while i < end:
                    fired[i] = True
                    if active[i]:
                        last = at[i]
                        i += np.searchsorted(at[i:end], last + limit, "right")
                    else:
                        i += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fired)], names=[*columns, "fired"])

    columns = df.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", fired boolean"
    return ordered.mapInArrow(run, schema)


def created(raised: DataFrame, title: Column | None = None, details: Column | None = None) -> DataFrame:
    """Stored alerts of fired ones (user, alert_type, severity, event_id, event_ts): an id of their own, Open, with title and JSON details.

    The id is a hash of user, type and event, so a re-delivered event makes the
    same alert again, and an upsert on the id keeps one.
    """
    number = F.xxhash64("user", "alert_type", "event_id")
    text = F.concat_ws(" ", F.col("severity"), F.replace("alert_type", F.lit("_"), F.lit(" ")), F.lit("for"), F.col("user")) if title is None else title
    return raised.select(
        number.alias("alert_id"), "user", "alert_type", "severity", text.alias("title"), (F.lit("{}") if details is None else details).alias("details"), F.lit("Open").alias("status"),
        F.col("event_ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def add(table: Store, raised: DataFrame, title: Column | None = None, details: Column | None = None) -> DataFrame:
    """Puts fired alerts into an alert table (sinks.alert_table()) and gives their rows back, ids and all; an alert that is there already stays as it is."""
    new = cut(created(raised, title, details).withColumn("updated_at", F.col("created_at")))
    known = table.read()
    fresh = new if known is None else new.join(known.select("alert_id"), "alert_id", "left_anti").select(new.columns)
    table.upsert(fresh)
    return new


def change(table: Store, changes: DataFrame) -> DataFrame:
    """Applies the last change (alert_id, status, changed_at) of each alert to an alert table, and gives the changed rows; unknown alerts have none.

    A terminal status fills in resolved_at, another one empties it.
    """
    if bad := changes.filter(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False))).limit(1).count():
        raise ValueError(f"{bad} unknown status")
    last = current_status(changes).join(changes.groupBy("alert_id").agg(F.max("changed_at").alias("changed_")), "alert_id")
    old = table.read()
    if old is None:
        return changes.limit(0)
    told = join_summary(old.drop("status", "resolved_at", "updated_at"), last, ["alert_id"])
    rows = cut(told.withColumn("updated_at", F.col("changed_")).select(*old.columns))
    table.upsert(rows)
    return rows


def by_id(table: Store, alert_id: int) -> DataFrame:
    """One alert, from its bucket's files alone, with its details as structure; no row for an unknown id."""
    return opened(table.read_key(alert_id=alert_id))


def opened(rows: DataFrame) -> DataFrame:
    """Alerts with their JSON details as a map of texts; broken details are an empty map."""
    return rows.withColumn("details", F.coalesce(F.from_json("details", "map<string, string>"), F.map_from_arrays(F.array(), F.array()).cast("map<string, string>")))


def current_status(log: DataFrame) -> DataFrame:
    """alert_id, status and resolved_at of a log (alert_id, status, changed_at); only terminal states are resolved."""
    if bad := log.filter(~F.col("status").isin(STATUSES)).limit(1).count():
        raise ValueError(f"{bad} unknown status")
    last = log.groupBy("alert_id").agg(F.max(F.struct("changed_at", "status")).alias("l"))
    return last.select("alert_id", "l.status", F.when(F.col("l.status").isin(TERMINAL), F.col("l.changed_at")).alias("resolved_at"))


def resolve_on_verdict(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Active alerts of users with a verdict take its state: Confirmed resolves, Cleared is a false positive."""
    to = F.when(F.col("verdict") == "Confirmed", "Resolved").when(F.col("verdict") == "Cleared", "False Positive")
    active = F.col("status").isin("Open", "Acknowledged")
    joined = alerts.join(verdicts, "user", "left")
    return joined.withColumn("status", F.when(active & to.isNotNull(), to).otherwise(F.col("status"))).drop("verdict")


def escalate(alerts: DataFrame, alert_ids: DataFrame) -> DataFrame:
    """Escalated alerts are acknowledged, and get a case id."""
    chosen = alert_ids.select("alert_id", F.lit(True).alias("escalated_")).distinct()
    out = alerts.join(chosen, "alert_id", "left")
    return out.withColumns({"status": F.when(F.col("escalated_"), "Acknowledged").otherwise(F.col("status")), "escalated": F.coalesce("escalated_", F.lit(False))}).drop("escalated_")


def escalated_cases(alerts: DataFrame, alert_ids: DataFrame, cases: DataFrame) -> DataFrame:
    """Pending records (user, status, notes, alert_id) of escalated alerts' users that have none yet; of several alerts the smallest id."""
    chosen = alerts.join(alert_ids.select("alert_id").distinct(), "alert_id", "left_semi").join(cases.select("user"), "user", "left_anti")
    first = chosen.groupBy("user").agg(F.min("alert_id").alias("alert_id"))
    return first.select("user", F.lit("Pending").alias("status"), F.concat(F.lit("Escalated from alert "), F.col("alert_id").cast("string")).alias("notes"), "alert_id")


def rebuild(scores: DataFrame, high: float, score: str = "score") -> DataFrame:
    """One alert per user of tier High; Critical from 0.85 on."""
    return scores.filter(F.col(score) >= high).select("user", F.lit("high_risk").alias("alert_type"), F.when(F.col(score) >= 0.85, "Critical").otherwise("High").alias("severity"), F.lit("Open").alias("status"))


def status_counts(alerts: DataFrame) -> DataFrame:
    """A count per status, zero included."""
    return alerts.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower().replace(" ", "_")) for s in STATUSES])
