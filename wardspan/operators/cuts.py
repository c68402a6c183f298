"""Lineage cuts that survive lost executors, and where intermediate data lie."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cuts whose files are there: the JVM, a weak reference to the RDD that reads them, and their folder.
_KEPT: list[tuple] = []
#: release() runs the driver's collector once in so many seconds at most.
COLLECT_SECONDS = 10.0
_collected = 0.0


def shared_top(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; unset, a temporary one in local mode and an error on a cluster, where no folder of ours would be shared."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _reader(df: DataFrame):
    """The RDD that reads a cut's files, and their folder; None if df is no cut."""
    plan = df._jdf.queryExecution().analyzed()
    told = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
    return (plan.rdd(), told.get()) if told is not None and told.isDefined() else None


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints into the shared folder.

    Its files go once no plan refers to them, at the next cut or release after
    that; checkpoints of the caller's own stay as the session has it.
    """
    spark = df.sparkSession
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_top(spark))
    out = df.checkpoint(eager=True)
    sweep(spark)
    if found := _reader(out):
        _KEPT.append((spark._jvm, spark._jvm.java.lang.ref.WeakReference(found[0]), found[1]))
    return out


def sweep(spark: SparkSession) -> None:
    """Deletes the files of cuts that no plan refers to any more."""
    for entry in list(_KEPT):
        jvm, reader, path = entry
        if jvm is not spark._jvm:
            _KEPT.remove(entry)
        elif reader.get() is None:
            delete(spark, path)
            _KEPT.remove(entry)


def release(*cuts: DataFrame) -> None:
    """Deletes the files of cut() results that nothing reads any more: what came of them has to be cut or written itself.

    Now and then the driver's collector runs, as Spark removes the files of
    finished shuffles only once their plans have been collected.
    """
    global _collected
    spark = cuts[0].sparkSession
    for df in cuts:
        if found := _reader(df):
            delete(spark, found[1])
            _KEPT[:] = [entry for entry in _KEPT if entry[2] != found[1]]
    if time.monotonic() - _collected > COLLECT_SECONDS:
        spark._jvm.System.gc()
        _collected = time.monotonic()
    sweep(spark)


def join_summary(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner", dealt: bool = False) -> DataFrame:
    """rows joined with a summary that has each key once.

    A summary comes dealt by its keys, and Spark splits a hot key's rows between
    tasks only in joins that deal out both sides; a hash beside the keys makes it
    do so. Rows that are ``dealt`` come from a window by the keys, so a key's rows
    lie in one task already: they stay there, and only the summary moves.
    """
    if dealt:
        return rows.join(summary, keys, how)
    mark = F.xxhash64(*keys)
    return rows.withColumn("mark_", mark).join(summary.withColumn("mark_", mark), ["mark_", *keys], how).drop("mark_")
