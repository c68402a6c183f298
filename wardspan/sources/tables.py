"""The driver's tables, and normalised events made of its ``events`` table.

The table has no security logs, so sources, actions, resources and addresses are
fixed functions of its columns; EVENTS_SQL is the same view in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the view shows for each event type and number k of the props.
SOURCES = {"signup": "azure_ad", "view": "cert_http", "click": "github_events", "error": "aws_cloudtrail", "purchase": "cert_file"}
ACTIONS = {
    "signup": ["AssumeRole", "CreateUser", "ConsoleLogin", "GetSessionToken"],
    "view": ["GetObject", "ListBuckets", "WWW Visit", "GetSecretValue"],
    "click": ["Code push", "Pull request", "Issue comment", "Repository forked"],
    "error": ["access denied", "request error", "login (denied)", "not found"],
    "purchase": ["File Copy", "File Write", "File Open", "File Delete"],
}
RESOURCES = [
    "iam role admin", "s3 prod backup", "reports/q1.docx", "tools/setup.exe", "archive.zip", "http://linkedin.com/jobs",
    "http://dropbox.com/f", "http://pastebin.com/x", "src/main.py", "hr/salary.xlsx", "vpn-gateway", "",
]
COUNTRIES = ["US", "DE", "FR", "BR", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def by_type(of: dict, make) -> Column:
    out = F.lit(None)
    for kind, value in of.items():
        out = F.when(F.col("event_type") == kind, make(value)).otherwise(out)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user, event_ts, source, action, resource, ip_address, country, value, k."""
    return view(table(spark, sf_dir, "events"))


def view(rows: DataFrame, also: list[str] | None = None) -> DataFrame:
    """The view of events() over rows of the table, or of a stream of it, and other columns of it."""
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.select(
        "event_id",
        F.col("user_id").cast("string").alias("user"),
        F.col("ts").alias("event_ts"),
        by_type(SOURCES, F.lit).alias("source"),
        by_type(ACTIONS, lambda names: pick(names, k)).alias("action"),
        pick(RESOURCES, k).alias("resource"),
        F.concat(F.lit("10.0.0."), (k % 16).cast("string")).alias("ip_address"),
        pick(COUNTRIES, k).alias("country"),
        "value",
        k.alias("k"),
        *(also or []),
    )


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_pick = lambda values: f"{sql_list(values)}[k % {len(values)} + 1]"
EVENTS_SQL = f"""ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS "user", ts AS event_ts,
         CASE event_type {' '.join(f"WHEN '{t}' THEN '{s}'" for t, s in SOURCES.items())} END AS source,
         CASE event_type {' '.join(f"WHEN '{t}' THEN {_pick(a)}" for t, a in ACTIONS.items())} END AS action,
         {_pick(RESOURCES)} AS resource, '10.0.0.' || CAST(k % 16 AS VARCHAR) AS ip_address,
         {_pick(COUNTRIES)} AS country, value, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
