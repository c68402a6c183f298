"""The live side as Structured Streaming: event files in, de-duplicated and scored rows out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from wardspan.functions import times as T
from wardspan.operators.cuts import cut, delete, shared_top
from wardspan.streaming import arrivals

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int | None = 8) -> DataFrame:
    """Parquet event files as they arrive; event_ts is a timestamp, as watermarks need, of the UTC wall clock ts.

    With files_per_batch None all files that are there are one batch, so that no row is late.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    raw = reader.parquet(path)
    return raw.withColumn("event_ts", F.timestamp_micros(T.micros(raw, "ts"))).withColumn("user", F.col("user_id").cast("string"))


def dedup(stream: DataFrame, delay: str = "20 minutes", key: str = "event_id") -> DataFrame:
    """Each id once within the delay; rows without an id all stay apart by a key of their own."""
    own = F.coalesce(F.col(key).cast("string"), F.uuid())
    return stream.withColumn("key_", own).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["key_"]).drop("key_")


def daily_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and value of each user and UTC day; a day is final once the watermark has passed it."""
    return (
        stream.withWatermark("event_ts", delay)
        .groupBy("user", F.window("event_ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.round(F.sum("value"), 4).alias("value_sum"))
        .select("user", F.to_date(T.utc_clock(F.col("w.start"))).alias("day"), "event_count", "value_sum")
    )


def hopping(stream: DataFrame, delay: str = "1 hour", length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """A day's window every hour, as the rolling window's approximation in a stream."""
    return (
        stream.withWatermark("event_ts", delay)
        .groupBy("user", F.window("event_ts", length, step).alias("w"))
        .agg(F.count(F.lit(1)).alias("events_in_window"))
        .select("user", T.utc_clock(F.col("w.end")).alias("window_end"), "events_in_window")
    )


def hourly_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events of each user and hour: what the state of windows that hop by an hour has to hold."""
    counts = stream.withWatermark("event_ts", delay).groupBy("user", F.window("event_ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user", T.utc_clock(F.col("w.start")).alias("hour"), "n")


def hopped(hours: DataFrame, length: int = 24) -> DataFrame:
    """The rows of hopping() from those of hourly_counts() in update mode (batch_): an hour's last count is in each window of ``length`` hours that it lies in."""
    last = hours.repartition("user").groupBy("user", "hour").agg(F.max(F.struct("batch_", "n")).alias("l"))  # a user's hours are few
    ends = last.select("user", "hour", F.col("l.n").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(length))).alias("i"))
    return ends.groupBy("user", (F.col("hour") + F.make_dt_interval(hours="i")).alias("window_end")).agg(F.sum("n").alias("events_in_window"))


def alerts(stream: DataFrame, minutes: int = 60, delay: str = "1 day") -> DataFrame:
    """Events of type error as alerts, one per user in so many minutes; state is a user's last alert time.

    A batch's rows are read in order of event time. A user's state goes once the
    watermark has passed its quiet time.
    """
    limit = minutes * 60_000_000

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        last, at = state.get[0] if state.exists else None, rows["at"].to_numpy()
        fired, i = [], 0 if last is None else int(np.searchsorted(at, last + limit, "right"))
        while i < len(at):
            fired.append(i)
            last = int(at[i])
            i += int(np.searchsorted(at[i:], last + limit, "right"))
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), (last + limit) // 1000) + 1)
        kept = rows.iloc[fired]
        yield pd.DataFrame({"user": key[0], "event_id": kept["event_id"], "at": kept["at"]})

    rows = stream.filter("event_type = 'error'").withColumn("at", F.unix_micros("event_ts")).withWatermark("event_ts", delay).select("user", "event_id", "event_ts", "at")
    found = rows.groupBy("user").applyInPandasWithState(run, "user string, event_id long, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("user", "event_id", F.timestamp_micros("at").alias("event_ts"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    return f"{shared_top(spark)}/stream-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, folder: str) -> list[str]:
    """The newest log file of a checkpoint's part, or the file itself; none if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    numbered = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().isdigit()] if fs.getFileStatus(at).isDirectory() else [at]
    out = []
    for p in sorted(numbered, key=lambda p: int(p.getName()) if p.getName().isdigit() else 0)[-1:]:
        source = fs.open(p)
        try:
            out.append(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
    return out


def is_sound(spark: SparkSession, state: str) -> bool:
    """Whether a checkpoint's identity, newest offsets and newest commit can be read; one that isn't there is sound."""
    def is_json(text: str) -> bool:
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    for text in _texts(spark, f"{state}/metadata"):
        if not is_json(text):
            return False
    for part in ("offsets", "commits"):
        for text in _texts(spark, f"{state}/{part}"):
            head, *lines = text.strip().split("\n")
            if not head.startswith("v") or not lines or not all(line == "-" or is_json(line) for line in lines):
                return False
    return True


def set_aside(spark: SparkSession, folder: str) -> str:
    """Moves what a stream keeps in a folder into one of its own, so that the next start is a fresh one; gives its place."""
    to = f"{folder}/broken-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    for part in ("state", "out"):
        if fs.exists(path(folder, part)):
            fs.rename(path(folder, part), path(to, part))
    return to


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder that is deleted in the end; what is to outlive it has to be cut."""
    folder = shared_folder(spark)
    try:
        yield folder
    finally:
        delete(spark, folder)


def rows_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What run_available() has put out in a folder, as a stream; each start takes all that is new as one batch."""
    return spark.readStream.schema(StructType([*schema.fields, StructField("b", IntegerType())])).parquet(f"{folder}/out").drop("b")


def ingest_stream(raw: DataFrame, folder: str, ae_live: DataFrame | None = None, timeout: int | None = None, **how) -> DataFrame:
    """Scored events (arrivals.scored()) of a stream of raw ones (event_id, source, raw) so far; what it keeps lies in ``folder``.

    What came before an event is in the state of its user, so a batch's work
    depends on the batch alone. A batch that is run again after a failure replaces
    its own part, and a new start on the same folder goes on where the last one
    ended.
    """
    with arrivals.keyed_state(raw.sparkSession):
        return run_available(arrivals.scored(raw, ae_live, **how), timeout=timeout, folder=folder).drop("batch_")


def run_available(stream: DataFrame, mode: str = "append", timeout: int | None = None, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives its rows, of earlier starts on the same folder too.

    batch_ is a row's batch: in update mode a key's last row counts and others go
    by the caller. Without a folder the rows are cut and nothing else is kept. A
    folder whose checkpoint can't be read is set aside, and the stream begins
    again with all its input.
    """
    spark, top = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    out = f"{top}/out"
    if not is_sound(spark, f"{top}/state"):
        set_aside(spark, top)

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch_", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(put).start()
    try:
        if query.awaitTermination(timeout) is False:
            raise TimeoutError("the stream didn't end")
        try:
            rows = spark.read.option("basePath", out).parquet(out).drop("b")
        except AnalysisException:  # no batch so far
            rows = spark.createDataFrame([], stream.withColumn("batch_", F.lit(0)).schema)
        return rows if folder else cut(rows)
    finally:
        query.stop()
        if not folder:
            delete(spark, top)
