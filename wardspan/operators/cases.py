"""Investigation records: a fold over a log of saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_STATUSES = ["Pending", "Under Review", "Confirmed", "Cleared"]
LOG = ["user", "saved_at", "status", "analyst", "note"]


def records(log: DataFrame) -> DataFrame:
    """user, status, analyst, notes, created_at, updated_at, history of saves (user, saved_at, status, analyst, note).

    The first save makes the record and no entry of its history.
    """
    entry = F.struct("saved_at", "status", "analyst", "note")
    saves = log.groupBy("user").agg(F.array_sort(F.collect_list(entry)).alias("saves"))
    last = F.element_at("saves", -1)
    return saves.select(
        "user", last.status.alias("status"), last.analyst.alias("analyst"), last.note.alias("notes"), F.element_at("saves", 1).saved_at.alias("created_at"),
        last.saved_at.alias("updated_at"), F.slice("saves", 2, F.greatest(F.size("saves") - 1, F.lit(0))).alias("history"),
    )


def bulk_import(scores: DataFrame, cases: DataFrame, high: float, score: str = "score") -> DataFrame:
    """Pending records for users of tier High that have none."""
    return scores.filter(F.col(score) >= high).join(cases.select("user"), "user", "left_anti").select("user", F.lit("Pending").alias("status"), F.lit("").alias("analyst"))


def with_suggestions(cases: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Attaches texts (user, suggestion); users without a record get a pending one."""
    return cases.join(suggestions, "user", "full_outer").withColumn("status", F.coalesce("status", F.lit("Pending")))


def list_cases(cases: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, of one status if told."""
    if status is not None and status not in CASE_STATUSES:
        raise ValueError(f"unknown status {status}")
    return (cases if status is None else cases.filter(F.col("status") == status)).orderBy(F.desc("updated_at"), "user").limit(limit)


def save(spark: SparkSession, path: str, saves: DataFrame) -> None:
    """Appends saves (user, saved_at, status, analyst, note) to the log at path; records() of load() are the cases."""
    if bad := saves.filter(~F.coalesce(F.col("status").isin(CASE_STATUSES), F.lit(False))).limit(1).count():
        raise ValueError(f"{bad} unknown status")
    saves.select(*LOG).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The log at path."""
    return spark.read.parquet(path)


def get(cases: DataFrame, user: str) -> DataFrame:
    """A user's record, no row without one."""
    return cases.filter(F.col("user") == user)


def store_of(spark: SparkSession, path: str) -> DataFrame:
    """store_rows() of a case store with one JSON object per file."""
    return store_rows(spark.read.text(path, wholetext=True))


def store_rows(texts: DataFrame) -> DataFrame:
    """user, status, analyst, notes and history of JSON objects (value) keyed by user; history is text or a list. Broken objects go."""
    doc = texts.select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    each = doc.select(F.explode(F.try_variant_get("v", "$", "map<string, variant>")).alias("user", "r"))
    at = lambda k: F.try_variant_get("r", f"$.{k}", "string")
    history = F.from_json(at("history"), "array<struct<status string, analyst string, note string, timestamp string>>")
    return each.select("user", at("status").alias("status"), F.coalesce(at("analyst"), F.lit("")).alias("analyst"), F.coalesce(at("notes"), F.lit("")).alias("notes"), F.coalesce(history, F.array().cast(history_type())).alias("history"))


def history_type() -> str:
    return "array<struct<status:string,analyst:string,note:string,timestamp:string>>"


def without_user(df: DataFrame, user: str) -> DataFrame:
    return df.filter(~F.col("user").eqNullSafe(F.lit(user)))
