"""Ingest with a state for each user: every event is scored by what came before it, in order of arrival.

A user's state is a total, the last number of each action, address and country,
and the last hours by time of ingest, in blocks of hours that a timer deletes.
Stored events are never read. Alerts keep the last alerts of a user and type with
their status, and take new alerts and changes of status in one state.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardspan.functions import times
from wardspan.operators import alerts, features, history, ingest, scoring
from wardspan.operators.cuts import cut

HOUR = 3_600_000_000
#: Events from which an hour is a block of its own, and parts of a user's keys where all of them are kept.
BLOCK, PARTS = 1024, 256
#: States that users' and types' alerts lie in by a hash; part of what a checkpoint holds, so it stays.
BUCKETS = 4096
#: Stands for a time that is null, which precedes all others.
NO_TIME = -(1 << 62)
#: The keys of which an event's history knows the last number.
KINDS = {"first_time_action": history.action_key, "new_ip": history.ip_key, "geo_rarity": history.country_key}
#: Settings of streams with keyed state: RocksDB, as states of several variables need it, no batches without rows, as timers of the clock would ask for them without end, and a batch that writes its changes instead of whole files.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here have SETTINGS, so timers run with the next batch that has rows; the session's own settings come back."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in one frame."""
    first, *rest = frames
    return pd.concat([first, *rest], ignore_index=True) if rest else first


class UserHistory(StatefulProcessor):
    """One user's events in order of arrival (at, then event id), with what came before each.

    ``sums`` are columns that are summed over the last ``hours``. Events are kept
    in blocks of whole hours, each named by its last hour: a batch's events of
    hours with few of them share a block, one with BLOCK or more has its own. A
    block has its sums, and its events in chunks of a batch each; chunks are read
    only for blocks in which a window begins. A timer deletes a block when no
    window can reach it. Keys have their last number; those out of the last
    ``cap`` events go, and the others lie beside the total, without a cap in parts.
    Calls to the state take longer than the work between them, so a batch makes
    few, whatever the number of its events.
    """

    def __init__(self, sums: list[str], hours: int, cap: int | None):
        self.sums, self.length, self.cap = sums, hours * HOUR, cap
        self.parts = 1 if cap is not None else PARTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, last string")
        self.last = handle.getMapState("last", "part int", "told string")
        self.hours = handle.getMapState("hours", "hour long", "since long, upto long, sums array<long>, chunks long")
        self.chunks = handle.getMapState("chunks", "hour long, chunk long", "at binary, counts binary")

    def store(self, at: np.ndarray, counts: np.ndarray, known: dict[int, tuple]) -> None:
        """Puts sorted times and a row of counts for each into blocks; ``known`` are those that are there."""
        hour = at // HOUR
        starts = np.flatnonzero(np.append(True, hour[1:] != hour[:-1])).tolist() if len(at) else []
        a = 0
        for b, after in zip([*starts[1:], len(at)], [*starts[2:], len(at), len(at)]):
            if b < len(at) and after - a <= BLOCK:
                continue
            name = int(hour[b - 1])
            since, upto, before, chunk = known.get(name, (int(at[a]), int(at[b - 1]), 0, 0))
            if not chunk:
                self.handle.registerTimer((name * HOUR + HOUR + self.length) // 1000 + 1)
            sums = (np.array(before, np.int64) + counts[a:b].sum(axis=0)).tolist()
            self.hours.updateValue((name,), (min(since, int(at[a])), max(upto, int(at[b - 1])), sums, chunk + 1))
            self.chunks.updateValue((name, chunk), (at[a:b].tobytes(), counts[a:b].tobytes()))
            a = b

    def remember(self, seqs: dict[tuple[str, str], int], total: int, before: dict[int, dict[tuple[str, str], int]]) -> None:
        """Puts the total, and the last numbers of keys into their parts."""
        told = None
        for part, old in before.items():
            now = old | {k: n for k, n in seqs.items() if self.part(k) == part}
            if self.cap is not None:
                now = {k: n for k, n in now.items() if total + 1 - n <= self.cap}
            told = json.dumps([[*k, n] for k, n in now.items()])
            if self.cap is None:
                self.last.updateValue((part,), (told,))
        self.total.update((total, told if self.cap is not None else None))

    def part(self, key: tuple[str, str]) -> int:
        return zlib.crc32("".join(key).encode("utf-8", "surrogatepass")) % self.parts if self.parts > 1 else 0

    def remembered(self, keys, told: tuple | None) -> dict[int, dict[tuple[str, str], int]]:
        """For each part that holds one of the keys its keys' last numbers; ``told`` is the value beside the total."""
        if self.cap is not None:
            found = {0: told[1:] if told and told[1] else None}
        else:
            found = {part: self.last.getValue((part,)) for part in {self.part(k) for k in keys}}
        return {part: {(k, v): n for k, v, n in json.loads(of[0])} if of else {} for part, of in found.items()}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows (kind, value, seq, at, counts) of history_state()."""
        total, seqs = 0, {}
        for kind, rows in initialState.groupby("kind"):
            if kind == "total":
                total = int(rows["seq"].max())
            elif kind == "event":
                rows = rows.sort_values("at")
                self.store(rows["at"].to_numpy(np.int64), np.array(rows["counts"].tolist(), np.int64), {})
            else:
                seqs |= {(kind, value): int(seq) for value, seq in zip(rows["value"], rows["seq"])}
        told = self.total.get()
        self.remember(seqs, max(total, told[0] if told else 0), self.remembered(seqs, told))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = whole(rows)
        order = np.lexsort((df["tie"].to_numpy(np.int64), df["at"].to_numpy(np.int64)))
        told = self.total.get()
        before, n = told[0] if told else 0, len(df)
        seqs: dict[tuple[str, str], int] = {}
        held = df["keys"].to_numpy()[order]
        keys = {kind: [(kind, of[j]) if isinstance(of[j], str) else None for of in held] for j, kind in enumerate(KINDS)}
        parts = self.remembered({k for of in keys.values() for k in of if k is not None}, told)
        old = {k: seq for of in parts.values() for k, seq in of.items()}
        new = {}
        for kind, of in keys.items():
            new[kind] = np.zeros(n, bool)
            for i, k in enumerate(of):
                if k is not None:
                    same = seqs.get(k, old.get(k))
                    new[kind][i] = same is None or self.cap is not None and before + 1 + i - same > self.cap
                    seqs[k] = before + 1 + i
        self.remember(seqs, before + n, parts)

        at, counts = df["at"].to_numpy(np.int64)[order], np.stack(df["counts"].to_numpy()[order]).astype(np.int64)
        since = at - self.length
        running = np.vstack([np.zeros(counts.shape[1], np.int64), np.cumsum(counts, axis=0)])
        inside = running[1:] - running[np.searchsorted(at, since, "left")]
        known = {k[0]: tuple(v) for k, v in self.hours.iterator()} if before else {}
        inside += self.earlier(since, known)
        self.store(at, counts, known)
        found = np.column_stack([np.arange(before + 1, before + n + 1), *new.values(), inside])
        yield pd.DataFrame({"user": key[0], "event": df["event"].to_numpy()[order], "told": list(found)})

    def earlier(self, since: np.ndarray, known: dict[int, tuple]) -> np.ndarray:
        """Sums of the stored events from each of the sorted times on."""
        out = np.zeros((len(since), 1 + len(self.sums)), np.int64)
        for hour, (first, newest, sums, n) in known.items():
            whole, none = np.searchsorted(since, first, "right"), np.searchsorted(since, newest, "right")
            out[:whole] += np.array(sums, np.int64)
            if whole < none:
                parts = [self.chunks.getValue((hour, c)) for c in range(n)]
                at = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
                counts = np.concatenate([np.frombuffer(p[1], np.int64).reshape(-1, out.shape[1]) for p in parts])
                order = np.argsort(at, kind="stable")
                running = np.vstack([np.zeros(out.shape[1], np.int64), np.cumsum(counts[order], axis=0)])
                out[whole:none] += running[-1] - running[np.searchsorted(at[order], since[whole:none], "left")]
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hour = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.length) // HOUR - 1
        told = self.hours.getValue((hour,))
        if told is not None:
            self.hours.removeKey((hour,))
            for c in range(told[3]):
                self.chunks.removeKey((hour, c))
        yield from ()

    def close(self) -> None:
        pass


def history_state(events: DataFrame, rule: dict = scoring.LIVE_RULE, hours: int = 24, cap: int | None = history.CAP) -> DataFrame:
    """A state to begin with, of events stored before (the columns of ingest.stored(), and ingested_at): user, kind, value, seq, at, counts.

    Their order of arrival is ingested_at, then event id. Of the last hours before
    each user's newest event the events themselves are told, of older ones only
    the last numbers of their keys.
    """
    e = features.event_features(events).withColumn("at", times.micros(events, "ingested_at"))
    e = cut(history.numbered(e, order=("ingested_at", "event_id")).select("user", "seq", "at", "action", "ip_address", "country", *rule))
    none = {"value": F.lit(None).cast("string"), "seq": F.lit(None).cast("long"), "at": F.lit(None).cast("long"), "counts": F.lit(None).cast("array<long>")}
    shape = lambda df, **kw: df.select("user", *[kw.get(c, none.get(c)).alias(c) for c in ("kind", "value", "seq", "at", "counts")])
    ends = e.groupBy("user").agg(F.max("seq").alias("n"), F.max("at").alias("newest"))
    out = shape(ends, kind=F.lit("total"), seq=F.col("n"))
    for kind, key in KINDS.items():
        value, counts = key()
        last = e.filter(counts).groupBy("user", value.alias("v")).agg(F.max("seq").alias("s"))
        if cap is not None:
            last = last.join(ends, "user").filter(F.col("n") + 1 - F.col("s") <= cap)
        out = out.unionByName(shape(last, kind=F.lit(kind), value=F.col("v"), seq=F.col("s")))
    recent = e.join(ends, "user").filter(F.col("at") >= F.col("newest") - hours * HOUR)
    each = F.array(F.lit(1).cast("long"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in rule])
    return out.unionByName(shape(recent, kind=F.lit("event"), at=F.col("at"), counts=each))


def arrived(raw: DataFrame, hours: int) -> DataFrame:
    """Stored form of a stream of raw events (event_id, source, raw), each id once, with ingested_at: that of raw, else the time of the batch.

    A time of arrival may lie up to ``hours`` behind the newest; the watermark
    follows it, and for so long a repeated id is known. Events without an id stay
    apart by a key of their own.
    """
    own = F.lit(None) if "ingested_at" not in raw.columns else F.timestamp_micros(times.micros(raw, "ingested_at"))
    timed = raw.withColumn("ingested_at", F.coalesce(own, F.current_timestamp())).withWatermark("ingested_at", f"{hours} hours")
    key = F.coalesce(F.col("event_id").cast("string"), F.uuid())
    return timed.withColumn("key_", key).dropDuplicatesWithinWatermark(["key_"]).drop("key_")


def with_scores(events: DataFrame, ae_live: DataFrame | None) -> DataFrame:
    """A stream of stored events, dealt out by user as the state needs them, with the scores of their user as an array; null without any.

    Rows that come back from Python are not known to lie by user, and a join there
    would deal them out again. A user's scores are one row, so that each event
    stays one.
    """
    events = events.repartition("user")
    if ae_live is None:
        return events.withColumn("scores", F.lit(None).cast("array<double>"))
    told = ae_live.select("user", F.struct(F.col("ae_live").cast("double").alias("score")).alias("of_"))
    return events.join(told.groupBy("user").agg(F.collect_list("of_").alias("of_")), "user", "left").withColumn("scores", F.col("of_.score")).drop("of_")


def scored(raw: DataFrame, ae_live: DataFrame | None = None, rule: dict[str, tuple[float, int]] = scoring.LIVE_RULE, cap: int | None = history.CAP, hours: int = 24, start: DataFrame | None = None) -> DataFrame:
    """A stream of raw events as a stream of scored ones: what ingest.scored() gives, but by arrival instead of event time.

    total_events, the unseen flags and the sums follow ingested_at, then the event
    id, over all batches; the sums reach back some hours of ingest time. ``start``
    is a state to begin with (history_state()), ae_live (user, ae_live) a model's
    scores; an event has a row for each score of its user. One user's batch is one
    task's work, so the batch's size bounds it. Start it within keyed_state().
    """
    made = with_scores(ingest.stored(arrived(raw, hours), ["ingested_at"]), ae_live)
    made = features.event_features(made)
    keys = [F.when(counts, value) for value, counts in (of() for of in KINDS.values())]
    ids = dict(made.dtypes)["event_id"]
    tie = F.coalesce(F.col("event_id").try_cast("long"), F.lit(-(1 << 63)))
    ready = made.withColumns({"at": F.unix_micros("ingested_at"), "tie": tie, "event_id": F.col("event_id").cast("string"), "metadata": F.to_json("metadata"), "events": F.lit(1).cast("long")} | {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in rule})
    # A user's rows cross to Python by themselves, which takes longer the more columns they have: an event is one text, figures are one array.
    kinds = dict(ready.dtypes)
    clocks = {"event_ts": times.micros(ready, "event_ts"), "ingested_at": F.col("at")}
    packed = ready.select(*[clocks.get(c, F.col(c)).alias(c) for c in (*ingest.STORED, "ingested_at", "scores")]).drop("user").schema
    event = F.to_json(F.struct(*[clocks.get(f.name, F.col(f.name)).alias(f.name) for f in packed]))
    narrow = ready.select("user", "at", "tie", event.alias("event"), F.array("events", *rule).alias("counts"), F.array(*keys).alias("keys"))
    out = narrow.groupBy("user").transformWithStateInPandas(UserHistory(list(rule), hours, cap), "user string, event string, told array<long>", "append", "EventTime", None if start is None else start.groupBy("user"))
    told = {"total_events": F.col("told")[0]} | {k: F.col("told")[i + 1] == 1 for i, k in enumerate(KINDS)} | {f"{c}_in_window": F.col("told")[i + 1 + len(KINDS)] for i, c in enumerate(("events", *rule))}
    out = out.withColumn("e", F.from_json("event", packed))
    own = {"event_id": F.col("e.event_id").cast(ids), "metadata": F.from_json("e.metadata", "map<string, string>"), "ingested_at": F.timestamp_micros("e.ingested_at")}
    clock = F.timestamp_micros("e.event_ts")
    own["event_ts"] = times.utc_clock(clock) if kinds["event_ts"] == "timestamp_ntz" else clock
    out = out.select(*[(F.col("user") if c == "user" else own.get(c, F.col(f"e.{c}"))).alias(c) for c in (*ingest.STORED, "ingested_at")], *[v.alias(k) for k, v in told.items()], "e.scores")
    out = history.flagged(out.withColumn("seq", F.col("total_events"))).drop("seq")
    out = out.withColumn("rule_live", scoring.live_rule({f"{c}_in_window": v for c, v in rule.items()}))
    return out.withColumn("ae_live", F.explode_outer("scores")).drop("scores")


class RecentAlerts(StatefulProcessor):
    """The alerts of the users and types in one bucket that lie up to ``limit`` microseconds back, with whether they are active; a user's and type's go after ``idle`` milliseconds without a row.

    A call to the state and a frame of their own for each user and type would take
    longer than the work on their rows, so one value holds a bucket's alerts.
    """

    def __init__(self, limit: int, idle: int):
        self.limit, self.idle = limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getValueState("alerts", "user array<string>, alert_type array<string>, seen array<long>, alert_id array<long>, at array<long>, active array<boolean>", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = whole(rows)
        told, now = self.alerts.get(), timerValues.getCurrentProcessingTimeInMs()
        held: dict[tuple, dict[int, tuple]] = {}
        seen = {}
        for user, kind, last, n, at, active in zip(*told) if told else ():
            if now - last <= self.idle:
                held.setdefault((user, kind), {})[n] = (at, active)
                seen[user, kind] = last
        of = list(zip(df["user"].tolist(), df["alert_type"].tolist()))
        seen |= dict.fromkeys(of, now)
        at, change, number, active = df["at"].tolist(), df["is_change"].tolist(), df["alert_id"].tolist(), df["active"].tolist()
        fired = []
        for i in np.lexsort((df["tie"].to_numpy(np.int64), df["is_change"].to_numpy(bool), df["at"].to_numpy(np.int64))).tolist():
            mine = held.get(of[i])
            if change[i]:
                if mine and number[i] in mine:
                    mine[number[i]] = (mine[number[i]][0], active[i])
                continue
            mine = {k: v for k, v in mine.items() if v[0] >= at[i] - self.limit} if mine else {}
            if not any(v[1] for v in mine.values()):
                fired.append(i)
                mine[number[i]] = (at[i], True)
            held[of[i]] = mine
        if told or held:
            kept = [(*k, seen[k], n, *v) for k, mine in held.items() for n, v in mine.items()]
            self.alerts.update(tuple(map(list, zip(*kept))) if kept else ([],) * 6)
        if fired:
            yield df.loc[fired, ["user", "alert_type", "severity", "event_id", "alert_id", "at"]]

    def close(self) -> None:
        pass


def fired(scored_events: DataFrame, changes: DataFrame | None = None, minutes: int = alerts.QUIET_MINUTES, at: str = "ingested_at", idle_hours: int = 24) -> DataFrame:
    """A stream of alerts by all four rules: user, alert_type, severity, event_id, alert_id and created_at.

    An alert fires unless an active one of its user and type lies up to some
    minutes before it; alerts start active, and ``changes`` (user, alert_type,
    alert_id, status, changed_at) say what became of them. Both inputs meet in one
    state, by user and type, in order of time within a batch, an alert before a
    change of the same time; a change of an alert that is not among the last
    minutes changes nothing. No row is too late, as the state goes by the hours of
    the clock since a user and type last had one. Start it within keyed_state().
    """
    ids = dict(scored_events.dtypes)["event_id"]
    raised = alerts.rules(F.col("total_events"), F.col("ae_live"), F.col("rarity"), F.col("first_time_action"), F.col("off_hours"))
    time = lambda df, c: F.coalesce(times.micros(df, c), F.lit(NO_TIME)).alias("at")
    new = scored_events.select("user", "event_id", time(scored_events, at), F.explode(raised).alias("a"))
    new = new.select(
        "user", "a.alert_type", "a.severity", F.col("event_id").cast("string").alias("event_id"), "at", F.coalesce(F.col("event_id").try_cast("long"), F.lit(-(1 << 63))).alias("tie"),
        F.lit(False).alias("is_change"), F.lit(True).alias("active"), F.xxhash64("user", "a.alert_type", "event_id").alias("alert_id"),
    )
    if changes is not None:
        none = lambda c: F.lit(None).cast("string").alias(c)
        told = changes.filter("alert_id IS NOT NULL").select(
            "user", "alert_type", none("severity"), none("event_id"), time(changes, "changed_at"), F.lit(0).cast("long").alias("tie"),
            F.lit(True).alias("is_change"), (~F.col("status").isin(alerts.TERMINAL)).alias("active"), "alert_id",
        )
        new = new.unionByName(told)
    out = new.withColumn("bucket", F.pmod(F.xxhash64("user", "alert_type"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(
        RecentAlerts(minutes * 60_000_000, idle_hours * 3_600_000), "user string, alert_type string, severity string, event_id string, alert_id long, at long", "append", "ProcessingTime"
    )
    created = F.timestamp_micros(F.when(F.col("at") != NO_TIME, F.col("at")))
    return out.select("user", "alert_type", "severity", F.col("event_id").cast(ids).alias("event_id"), "alert_id", times.utc_clock(created).alias("created_at"))
