"""Queries of the whole way from raw events to scores and alerts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions import patterns as P
from wardspan.functions import times as T
from wardspan.operators import history as H
from wardspan.operators import ingest as I
from wardspan.operators.alerts import STATUSES
from wardspan.operators.cuts import cut
from wardspan.plans.activity import LIVE_SQL, OFF
from wardspan.plans.history import FIRST, GEO, HIGH, NEW_IP, NUMBERED
from wardspan.plans.named import query
from wardspan.plans.scores import LIVE_RULE, rule_sql
from wardspan.sources.tables import EVENTS_SQL, events, table, view
from wardspan.streaming import arrivals as A
from wardspan.streaming import streams as S

KINDS = ["cert_file", "cert_device", "cert_logon", "cert_email", "cert_http", "azure_ad"]


def raw_events(e: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Raw JSON events of five endpoint sources and one cloud source, made of the view, and other columns of it."""
    k, at = F.col("k"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if dict(e.dtypes)["event_ts"] == "timestamp" else F.concat(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    source = F.when(F.col("source") == "github_events", "cert_email").when(F.col("source") == "aws_cloudtrail", F.when(k % 2 == 0, "cert_device").otherwise("cert_logon")).otherwise(F.col("source"))
    json = lambda **kw: F.to_json(F.struct(*[v.alias(n.rstrip("_")) for n, v in kw.items()]))
    base = {"date": at, "user": F.col("user"), "activity": F.col("action")}
    raws: dict[str, Column] = {
        "cert_file": json(**base, filename=F.col("resource"), to_removable_media=F.when(k % 6 == 0, "True").otherwise("False"), from_removable_media=F.when(k % 6 == 1, "true")),
        "cert_device": json(**base, pc=F.col("ip_address")), "cert_logon": json(**base, pc=F.col("ip_address")), "cert_http": json(**base, url=F.col("resource")),
        "cert_email": json(
            **base, to=F.when(k % 3 == 0, "a@Other.example").when(k % 3 == 1, "c@corp.example"), from_=F.lit("z@corp.example"), bcc=F.when(k % 5 == 0, "x@y.example"),
            attachments=F.when(k % 4 == 0, k.cast("string")).otherwise("none.txt"),
        ),
        "azure_ad": json(
            createdDateTime=at, userPrincipalName=F.col("user"), appDisplayName=F.col("action"), resourceDisplayName=F.col("resource"), ipAddress=F.col("ip_address"),
            location=F.struct(F.col("country").alias("countryOrRegion")),
        ),
    }
    raw = F.lit(None)
    for name in KINDS:
        raw = F.when(source == name, raws[name]).otherwise(raw)
    return e.select("event_id", source.alias("source"), raw.alias("raw"), *(also or []))


def ae_live(e: DataFrame) -> DataFrame:
    """A model's scores by the user's number, so that all rules of alerts are reached."""
    return e.select("user").distinct().withColumn("ae_live", (F.col("user").cast("int") % 10) / F.lit(10.0))


def scored_sql(time: str) -> str:
    """Views up to scored, in order of a time: event_ts, or ingested_at, which is up to 29 hours later, in an order of its own, and never the same twice."""
    over = f'OVER (PARTITION BY "user" ORDER BY {time} RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)'
    return f"""{EVENTS_SQL.replace("ev AS (", "all_ev AS (", 1)}, ev AS (SELECT * REPLACE (
      CASE WHEN source = 'aws_cloudtrail' AND k % 2 = 0 THEN 'Device:' || action WHEN source = 'aws_cloudtrail' THEN 'Logon:' || action ELSE action END AS action,
      CASE WHEN source = 'aws_cloudtrail' THEN ip_address WHEN source = 'github_events' THEN CASE k % 3 WHEN 0 THEN 'email→a@Other.example' WHEN 1 THEN 'email→c@corp.example' ELSE 'email' END
           ELSE resource END AS resource,
      CASE WHEN source = 'azure_ad' THEN ip_address ELSE '' END AS ip_address, CASE WHEN source = 'azure_ad' THEN country ELSE '' END AS country),
      event_ts + to_hours(CAST(event_id * 7 % 30 AS INTEGER)) + to_microseconds(event_id) AS ingested_at FROM all_ev), {LIVE_SQL},
  {NUMBERED.replace("FROM ev)", "FROM live)").replace("ORDER BY event_ts, event_id", f"ORDER BY {time}, event_id")},
  flags AS (SELECT *, CAST(first_time_action AS INTEGER) + CAST(new_ip AS INTEGER) + CAST(off_hours AS INTEGER) + CAST(high_volume AS INTEGER) + CAST(sensitive_resource AS INTEGER)
    + CAST(geo_rarity AS INTEGER) AS flags_fired FROM (SELECT *, {FIRST} AS first_time_action, {NEW_IP} AS new_ip, {OFF} AS off_hours, {HIGH} AS high_volume,
    regexp_matches(resource, '(?i)({P.SENSITIVE_RESOURCE})') AS sensitive_resource, {GEO} AS geo_rarity FROM n)),
  scored AS (SELECT *, count(*) {over} AS events_in_window, {rule_sql(over)} AS rule_live, round(flags_fired / 6.0, 4) AS rarity, CAST("user" AS INTEGER) % 10 / 10.0 AS ae_live FROM flags)"""


SCORED_SQL, ARRIVED_SQL = scored_sql("event_ts"), scored_sql("ingested_at")
COLUMNS = ["event_id", "user", "source", "action", "resource", "total_events", "events_in_window", "rule_live", "ae_live", *H.FLAGS, "rarity"]
SCORED_COLUMNS = ", ".join("seq AS total_events" if c == "total_events" else f'"{c}"' for c in COLUMNS)
INGEST_SQL = f"WITH {SCORED_SQL} SELECT {SCORED_COLUMNS} FROM scored"


def scored(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return I.scored(I.stored(raw_events(e)), ae_live(e), LIVE_RULE)


@query(INGEST_SQL)
def ingest_batch(spark, sf_dir) -> DataFrame:
    """Raw events normalised, with features, history, 24 h rule score, model score and rarity."""
    return scored(spark, sf_dir).select(*COLUMNS)


BATCHES = 3


def arrive(spark, sf_dir, folder: str) -> Iterator[DataFrame]:
    """Puts the table into a folder in order of arrival, a part at a time; gives a stream of what came so far as raw events, each of them twice."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("ingested_at", F.timestamp_micros(T.micros(e, "ts") + F.col("event_id") * 7 % 30 * 3_600_000_000 + F.col("event_id")))
    ends = e.agg(F.unix_micros(F.min("ingested_at")), F.unix_micros(F.max("ingested_at"))).first()
    part = F.floor((F.unix_micros("ingested_at") - F.lit(ends[0])) * BATCHES / F.lit(((ends[1] or 0) - (ends[0] or 0)) + 1))
    for k in range(BATCHES):
        e.filter(part == k).write.mode("append").parquet(folder)
        stream = S.event_stream(spark, folder, f"{S.EVENTS}, ingested_at timestamp", files_per_batch=None)
        yield raw_events(view(stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), ["ingested_at"]), ["ingested_at"])


@query(f"WITH {ARRIVED_SQL} SELECT {SCORED_COLUMNS} FROM scored")
def ingest_stream(spark, sf_dir) -> DataFrame:
    """Scored by arrival, in batches that come one after another; every event comes twice and counts once, and many come after later ones."""
    with S.scratch(spark) as folder:
        for raw in arrive(spark, sf_dir, f"{folder}/in"):
            out = S.ingest_stream(raw, f"{folder}/kept", ae_live(events(spark, sf_dir)))
        return cut(out.select(*COLUMNS))


FIRED_SQL = """candidates AS (
    SELECT "user", event_id, event_ts, 'new_user' AS alert_type, 'Low' AS severity FROM scored WHERE seq = 1
    UNION ALL SELECT "user", event_id, event_ts, 'ae_critical', CASE WHEN ae_live >= 0.7 THEN 'Critical' ELSE 'High' END FROM scored WHERE ae_live >= 0.5
    UNION ALL SELECT "user", event_id, event_ts, 'rarity_spike', CASE WHEN rarity >= 0.8 THEN 'Critical' ELSE 'High' END FROM scored WHERE rarity >= 0.6
    UNION ALL SELECT "user", event_id, event_ts, 'anomalous_behavior', 'High' FROM scored WHERE first_time_action AND off_hours),
  e AS (SELECT *, event_id % 4 < 2 AS active, row_number() OVER (PARTITION BY "user", alert_type ORDER BY event_ts, event_id) AS i FROM candidates),
  r AS (SELECT *, true AS fired, CASE WHEN active THEN event_ts END AS last FROM e WHERE i = 1
        UNION ALL SELECT e.*, coalesce(e.event_ts > r.last + INTERVAL 60 MINUTE, true), CASE WHEN e.active AND coalesce(e.event_ts > r.last + INTERVAL 60 MINUTE, true) THEN e.event_ts ELSE r.last END
        FROM r JOIN e ON e."user" = r."user" AND e.alert_type = r.alert_type AND e.i = r.i + 1)"""


@query(f'WITH RECURSIVE {SCORED_SQL}, {FIRED_SQL} SELECT "user", event_id, alert_type, severity FROM r WHERE fired')
def ingest_alerts(spark, sf_dir) -> DataFrame:
    """Alerts by all four rules, one per user, type and hour while the earlier one is open or acknowledged; states by the event's number."""
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    return I.fired(scored(spark, sf_dir), status).select("user", "event_id", "alert_type", "severity")


@query(f'WITH RECURSIVE {ARRIVED_SQL}, {FIRED_SQL.replace("event_ts", "ingested_at")} SELECT "user", event_id, alert_type, severity FROM r WHERE fired')
def alert_status_stream(spark, sf_dir) -> DataFrame:
    """The same rules over a stream by arrival; half of the alerts are resolved in the microsecond after they fire, as a second stream says."""
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.explode(F.array(*map(F.lit, ("new_user", "ae_critical", "rarity_spike", "anomalous_behavior"))))
    with S.scratch(spark) as folder:
        for raw in arrive(spark, sf_dir, f"{folder}/in"):
            scored_so_far = S.ingest_stream(raw, f"{folder}/kept", ae_live(events(spark, sf_dir)))
            stream = S.rows_stream(spark, f"{folder}/kept", scored_so_far.schema)
            told = stream.filter("event_id % 4 >= 2").select("user", "event_id", kind.alias("alert_type"), status.alias("status"), (F.col("ingested_at") + F.expr("INTERVAL 0.000001 SECOND")).alias("changed_at"))
            changes = told.select("user", "alert_type", F.xxhash64("user", "alert_type", "event_id").alias("alert_id"), "status", "changed_at")
            with A.keyed_state(spark):
                out = S.run_available(A.fired(stream, changes), folder=f"{folder}/alerts")
        return cut(out.select("user", "event_id", "alert_type", "severity"))


@query(f"""WITH {SCORED_SQL} SELECT "user", ae_live, rule_live, rarity, seq AS event_count FROM scored QUALIFY seq = max(seq) OVER (PARTITION BY "user")""")
def ingest_live_scores(spark, sf_dir) -> DataFrame:
    return I.live_scores(scored(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL} SELECT CASE WHEN k % 9 = 1 THEN 'nowhere' WHEN source = 'github_events' THEN 'cert_email' WHEN source = 'aws_cloudtrail' AND k % 2 = 0 THEN 'cert_device' WHEN source = 'aws_cloudtrail' THEN 'cert_logon' ELSE source END AS source,
    count(*) FILTER (k % 10 > 0 AND k % 9 <> 1) AS events, count(*) FILTER (k % 10 = 0 OR k % 9 = 1) AS rejected FROM ev GROUP BY 1""")
def replay_dry_run(spark, sf_dir) -> DataFrame:
    """What a replay would take, where a tenth of the texts is broken and some sources are unknown."""
    raw = raw_events(events(spark, sf_dir), ["k"])
    broken = raw.withColumn("raw", F.when(F.col("k") % 10 == 0, F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw")))
    return I.dry_run(broken.withColumn("source", F.when(F.col("k") % 9 == 1, "nowhere").otherwise(F.col("source"))))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, 'demo' AS "user", event_ts FROM ev ORDER BY event_ts, event_id LIMIT 500""")
def replay_of_one_user(spark, sf_dir) -> DataFrame:
    """The first 500 events as those of one user, as a replay's limit and override have it."""
    return I.replay(raw_events(events(spark, sf_dir)), "demo", 500).select("event_id", "user", "event_ts")
