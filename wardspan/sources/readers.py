"""Readers of logs: CSV, JSON in three shapes, Parquet, and generators of demo data.

All are lazy and split by Spark; a gzip file can't be split, so many smaller ones
are better than one.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.sources.envelopes import json_records

# Columns of endpoint logs, and header aliases of audit-trail CSV exports.
CERT_COLUMNS = {
    "logon": ["id", "date", "user", "pc", "activity"],
    "device": ["id", "date", "user", "pc", "activity"],
    "file": ["id", "date", "user", "pc", "filename", "activity", "to_removable_media", "from_removable_media"],
    "email": ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "activity", "size", "attachments", "content"],
    "http": ["id", "date", "user", "pc", "url", "activity", "content"],
}
TRAIL_ALIASES = {
    "eventTime": ["eventtime", "event_time", "timestamp", "time"],
    "eventName": ["eventname", "event_name", "action"],
    "userName": ["username", "user_name", "user", "useridentity_username"],
    "principalId": ["principalid", "useridentity_principalid"],
    "eventSource": ["eventsource", "event_source", "source"],
    "awsRegion": ["awsregion", "aws_region", "region"],
    "sourceIPAddress": ["sourceipaddress", "source_ip_address", "source_ip", "ip_address"],
    "bucketName": ["bucketname", "requestparameters_bucketname", "resource"],
}
DEFAULT_REGION = "us-east-1"


def cert_csv(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """An endpoint log; broken lines are dropped, only the asked columns are parsed, only a cohort's users kept."""
    schema = ", ".join(f"`{c}` string" for c in CERT_COLUMNS[kind])
    out = spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED", enforceSchema=False)
    out = out.select(*columns) if columns else out
    return out if cohort is None else out.join(cohort.select("user").distinct(), "user", "left_semi")


def limited(spark: SparkSession, paths: list[str], read, rows: int) -> DataFrame:
    """At most ``rows`` rows of each file."""
    out = None
    for p in paths:
        part = read(spark, p).limit(rows)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def records(text: Column) -> Column:
    """JSON texts of the records of an envelope {"Records": [...]}, an array, or one object; broken text has none."""
    doc = F.try_parse_json(text)
    inner = F.coalesce(F.try_variant_get(doc, "$.Records", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"), F.when(doc.isNotNull() & F.trim(text).startswith("{"), F.array(doc)))
    return F.filter(F.transform(F.coalesce(inner, F.array().cast("array<variant>")), lambda v: F.to_json(v)), lambda s: F.trim(s).startswith("{"))


def json_events(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """raw: a JSON text per record. whole takes a file's documents as they come, of any size (envelopes.json_records()), else each line is one; gzip is unpacked by name."""
    if whole:
        return json_records(spark, path)
    lines = spark.read.text(path, recursiveFileLookup=True)
    return lines.select(F.explode(records(F.col("value"))).alias("raw"))


def trail_csv(spark: SparkSession, path: str) -> DataFrame:
    """raw events of an audit trail's CSV export with any known header; rows without time or name go."""
    return trail_rows(spark.read.csv(path, header=True, recursiveFileLookup=True))


def trail_rows(df: DataFrame) -> DataFrame:
    """raw events of rows with any known heading."""
    names = {c.strip().lower().replace(" ", "_").replace(".", "_"): c for c in df.columns}
    at = lambda f: F.coalesce(*[F.nullif(F.trim(F.col(f"`{names[a]}`")), F.lit("")) for a in TRAIL_ALIASES[f] if a in names], F.lit(None).cast("string"))
    kept = df.filter(at("eventTime").isNotNull() & at("eventName").isNotNull())
    raw = F.struct(
        at("eventTime").alias("eventTime"), at("eventName").alias("eventName"), at("eventSource").alias("eventSource"), F.coalesce(at("awsRegion"), F.lit(DEFAULT_REGION)).alias("awsRegion"),
        at("sourceIPAddress").alias("sourceIPAddress"), F.struct(at("userName").alias("userName"), at("principalId").alias("principalId")).alias("userIdentity"),
        F.struct(at("bucketName").alias("bucketName")).alias("requestParameters"),
    )
    return kept.select(F.to_json(raw).alias("raw"))


def any_events(spark: SparkSession, path: str) -> DataFrame:
    """Chooses a reader by the path's extension: .csv, .json or .json.gz (whole documents), .jsonl, .parquet; a path without one is a folder of a mix."""
    name = path.lower().removesuffix(".gz")
    kind = os.path.splitext(name)[1]
    if kind == ".csv":
        return trail_csv(spark, path)
    if kind in (".jsonl", ".ndjson"):
        return json_events(spark, path)
    if kind == ".json":
        return json_events(spark, path, whole=True)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if not kind:
        return folder_events(spark, path)
    raise ValueError(f"no reader for {path}")


def folder_events(spark: SparkSession, path: str) -> DataFrame:
    """raw events of all CSV, JSON and JSON-lines files below a folder, whatever their mix; other files are left out."""
    out = spark.createDataFrame([], "raw string")
    held = lambda glob: spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    some = lambda glob: not held(glob).format("binaryFile").load(path).select("path").limit(1).isEmpty()
    for glob, whole in (("*.json", True), ("*.json.gz", True), ("*.jsonl", False), ("*.jsonl.gz", False), ("*.ndjson", False)):
        if some(glob):
            found = json_records(spark, path, glob=glob) if whole else held(glob).text(path).select(F.explode(records(F.col("value"))).alias("raw"))
            out = out.unionByName(found)
    for glob in ("*.csv", "*.csv.gz"):
        if some(glob):
            out = out.unionByName(trail_rows(held(glob).csv(path, header=True)))
    return out


def events_by_actor(raw: DataFrame) -> DataFrame:
    """user, timestamp and raw of source-hosting events, dealt by actor and in order of time within one; events without an actor go."""
    v = raw.select("raw", F.try_parse_json("raw").alias("v"))
    user = F.coalesce(F.nullif(F.try_variant_get("v", "$.actor.login", "string"), F.lit("")), F.try_variant_get("v", "$.actor.display_login", "string"))
    timed = v.select(user.alias("user"), F.try_variant_get("v", "$.created_at", "string").alias("timestamp"), "raw").filter("user IS NOT NULL AND user <> ''")
    return timed.repartition("user").sortWithinPartitions("user", "timestamp")


def scores_with_attribution(scores: DataFrame, attribution: DataFrame | None, needed: list[str]) -> tuple[DataFrame, list[str]]:
    """scores joined with a table of attributions by user where there is one, and the needed columns that are missing."""
    missing = [c for c in needed if c not in scores.columns]
    return (scores if attribution is None else scores.join(attribution, "user", "left")), missing


def detect(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate among the stripped column names."""
    names = {c.strip(): c for c in columns}
    return next((names[c] for c in candidates if c in names), None)


def scores_csv(spark: SparkSession, path: str) -> DataFrame:
    """user, score, and label and scenario where there are any, of a CSV with one of the known headings."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    user, score = detect(df.columns, ["user", "user_id", "User"]), detect(df.columns, ["ae_score", "ensemble_score", "score"])
    if not user or not score:
        raise ValueError("a user and a score column are needed")
    extra = [F.col(c).cast("int").alias(n) for n, c in (("label", detect(df.columns, ["is_insider", "label"])), ("scenario", detect(df.columns, ["scenario"]))) if c]
    return df.select(F.col(user).cast("string").alias("user"), F.col(score).cast("double").alias("score"), *extra)


def demo_scores(spark: SparkSession, n: int = 200, insiders: float = 0.07, seed: int = 42) -> DataFrame:
    """Invented scores: insiders stand higher. The same seed gives the same rows."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("id")), F.lit(1_000_000)) / 1e6
    return spark.range(n).select(
        F.format_string("USR%03d", "id").alias("user"), (draw(0) < insiders).cast("int").alias("label"), F.least(F.lit(1.0), draw(1) * 0.6 + F.when(draw(0) < insiders, 0.4).otherwise(0.0)).alias("score")
    )
