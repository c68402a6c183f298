"""Queries on events: normalising, features of user-days and users, joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions import patterns as P
from wardspan.functions import times as T
from wardspan.operators import features as X
from wardspan.operators import normalize as N
from wardspan.operators import scoring
from wardspan.operators.cuts import cut
from wardspan.plans.named import query
from wardspan.sources.tables import EVENTS_SQL, events, table

OFF = "(isodow(event_ts) >= 6 OR hour(event_ts) < 7 OR hour(event_ts) >= 19)"
LATE = "(isodow(event_ts) >= 6 OR hour(event_ts) < 7 OR hour(event_ts) >= 18)"
BOTH = "lower(lower(trim(action)) || ' ' || trim(resource))"
re2 = lambda family: rf"(?i)\b({family})\b".replace("'", "''")
MATCH = lambda text, family: f"regexp_matches({text}, '{re2(family)}')"
FLAG_SQL = {
    "sensitive_events": MATCH("trim(resource)", P.SENSITIVE_WORDS),
    "error_events": f"({MATCH('lower(trim(action))', P.ERROR)} OR contains(lower(action), '(denied)'))",
    "iam_sts_events": MATCH(BOTH, P.IAM), "data_exfil_events": MATCH(BOTH, P.EXFIL), "admin_events": MATCH(BOTH, P.ADMIN), "assume_role_events": MATCH(BOTH, P.ASSUME),
}
CLOUD_SQL = f"""cloud AS (
  SELECT "user", CAST(event_ts AS DATE) AS day, count(*) AS event_count, count(DISTINCT lower(trim(action))) AS unique_actions,
         count(DISTINCT nullif(trim(resource), '')) AS unique_resources,
         count(DISTINCT CASE WHEN trim(ip_address) NOT IN ('', '127.0.0.1', '::1') THEN trim(ip_address) END) AS unique_ips,
         count(*) FILTER ({OFF}) AS after_hours_events,
         {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in FLAG_SQL.items())}
  FROM ev GROUP BY ALL)"""


@query(f'WITH {EVENTS_SQL}, {CLOUD_SQL} SELECT * FROM cloud')
def cloud_user_day(spark, sf_dir) -> DataFrame:
    return X.cloud_user_day(events(spark, sf_dir), with_new=False)


@query(f"""
    WITH {EVENTS_SQL}, a AS (SELECT DISTINCT "user", CAST(event_ts AS DATE) AS day, lower(trim(action)) AS act FROM ev),
    f AS (SELECT *, min(day) OVER (PARTITION BY "user", act) AS first_day FROM a)
    SELECT "user", day, count(*) FILTER (day = first_day AND act <> '') AS new_action_count FROM f GROUP BY ALL""")
def cloud_user_day_new_actions(spark, sf_dir) -> DataFrame:
    return X.cloud_user_day(events(spark, sf_dir)).select("user", "day", "new_action_count")


@query(f"""
    WITH {EVENTS_SQL}
    SELECT event_id, CASE source WHEN 'aws_cloudtrail' THEN 'u' || "user" WHEN 'azure_ad' THEN 'u' || "user" ELSE "user" END AS "user", source, action,
           CASE WHEN source = 'cert_http' THEN 'http://x/' || k WHEN source = 'azure_ad' THEN 'r' || k WHEN source = 'aws_cloudtrail' THEN 'b' || k
                WHEN source = 'github_events' THEN 'o/r' || k ELSE 'f' || k || '.zip' END AS resource,
           CASE WHEN source IN ('aws_cloudtrail', 'azure_ad') THEN ip_address ELSE '' END AS ip_address
    FROM (SELECT * REPLACE (CASE WHEN source = 'github_events' THEN 'Code push (' || (k % 3) || CASE WHEN k % 3 = 1 THEN ' commit)' ELSE ' commits)' END
                                 ELSE action END AS action) FROM ev)""")
def normalize_events(spark, sf_dir) -> DataFrame:
    """Raw events of five sources, written as JSON and normalised again."""
    e, k = events(spark, sf_dir), F.col("k").cast("string")
    s = lambda **kw: F.to_json(F.struct(*[v.alias(n) for n, v in kw.items()]))
    name = F.concat(F.lit("u"), F.col("user"))
    raws = {
        "aws_cloudtrail": s(eventName=F.col("action"), userIdentity=F.struct(name.alias("userName")), requestParameters=F.struct(F.concat(F.lit("b"), k).alias("bucketName")), sourceIPAddress=F.col("ip_address")),
        "azure_ad": s(appDisplayName=F.col("action"), userPrincipalName=name, ipAddress=F.col("ip_address"), TargetResources=F.array(F.struct(F.concat(F.lit("r"), k).alias("id")))),
        "cert_http": s(user=F.col("user"), url=F.concat(F.lit("http://x/"), k), activity=F.col("action")),
        "cert_file": s(user=F.col("user"), filename=F.concat(F.lit("f"), k, F.lit(".zip")), activity=F.col("action")),
        "github_events": s(type=F.lit("PushEvent"), actor=F.struct(F.col("user").alias("login")), repo=F.struct(F.concat(F.lit("o/r"), k).alias("name")), payload=F.struct((F.col("k") % 3).alias("size"))),
    }
    raw = F.lit(None)
    for source, made in raws.items():
        raw = F.when(F.col("source") == source, made).otherwise(raw)
    return N.normalize(e.select("event_id", "source", raw.alias("raw"))).select("event_id", "user", "source", "action", "resource", "ip_address")


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing, json_valid(props) AS valid FROM events""")
def parse_props_metadata(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    parsed = e.select("event_id", F.try_parse_json("props").alias("p"))
    return parsed.select("event_id", N.field(F.col("p"), "k").try_cast("int").alias("k"), N.field(F.col("p"), "missing").alias("missing"), F.col("p").isNotNull().alias("valid"))


@query(f"""
    WITH {EVENTS_SQL}
    SELECT event_id, hour(event_ts)::INTEGER AS hour, (isodow(event_ts) - 1)::INTEGER AS weekday, isodow(event_ts) >= 6 AS is_weekend, {LATE} AS after_hours,
           hour(event_ts) < 7 OR hour(event_ts) >= 18 AS after_hours_hour_only, {OFF} AS off_hours
    FROM ev""")
def time_columns(spark, sf_dir) -> DataFrame:
    e = T.add_time_columns(events(spark, sf_dir), "event_ts")
    return e.select("event_id", "hour", "weekday", "is_weekend", "after_hours", T.after_hours_script(F.col("event_ts")).alias("after_hours_hour_only"), T.off_hours(F.col("event_ts")).alias("off_hours"))


def parts(e: DataFrame) -> dict[str, DataFrame]:
    """Endpoint logs made of the view: logons, files, devices, mails and pages with a user, day and after_hours."""
    e = e.withColumns({"id": F.col("event_id"), "day": F.to_date("event_ts"), "after_hours": T.after_hours_train(F.col("event_ts"))})
    of = lambda s: e.filter(F.col("source") == s)
    return {
        "logon": of("azure_ad").withColumn("pc", F.col("ip_address")),
        "file": of("cert_file").withColumn("filename", F.col("resource")),
        "device": of("aws_cloudtrail").withColumn("activity", F.when(F.col("k") % 2 == 0, "Connect").otherwise("Disconnect")),
        "email": of("github_events").withColumns({
            "to": F.when(F.col("k") % 3 == 0, "a@corp.example;b@other.example").when(F.col("k") % 3 == 1, "c@corp.example"),
            "bcc": F.when(F.col("k") % 5 == 0, "x@y.example"), "attachments": F.when(F.col("k") % 4 == 0, F.col("k").cast("string")).otherwise("none.txt"),
        }),
        "http": of("cert_http").withColumn("url", F.col("resource")),
    }


def daily_parts(spark, sf_dir) -> list[DataFrame]:
    p = parts(events(spark, sf_dir))
    return [X.logon_daily(p["logon"]), X.file_daily(p["file"]), X.usb_daily(p["device"]), X.email_daily(p["email"], F.lit("corp.example")), X.http_daily(p["http"])]


def one_table(spark, sf_dir) -> DataFrame:
    """The logs of parts() in one table, without a union: each event has a kind and all columns."""
    e, k = events(spark, sf_dir), F.col("k")
    kinds = {"azure_ad": "logon", "cert_file": "file", "aws_cloudtrail": "device", "github_events": "email", "cert_http": "http"}
    kind = F.lit(None)
    for source, name in kinds.items():
        kind = F.when(F.col("source") == source, name).otherwise(kind)
    return e.select(
        kind.alias("kind"), F.col("event_id").alias("id"), "user", F.col("event_ts").alias("ts"), F.to_date("event_ts").alias("day"), T.after_hours_train(F.col("event_ts")).alias("after_hours"),
        F.col("ip_address").alias("pc"), F.col("resource").alias("filename"), F.col("resource").alias("url"), F.when(k % 2 == 0, "Connect").otherwise("Disconnect").alias("activity"),
        F.when(k % 3 == 0, "a@corp.example;b@other.example").when(k % 3 == 1, "c@corp.example").alias("to"), F.lit("z@corp.example").alias("from"),
        F.when(k % 5 == 0, "x@y.example").when(k % 5 == 1, " ").alias("bcc"), F.when(k % 4 == 0, k.cast("string")).otherwise("none.txt").alias("attachments"),
    )


def daily(spark, sf_dir) -> DataFrame:
    table_ = one_table(spark, sf_dir).withColumn("bcc", F.nullif("bcc", F.lit(" ")))
    return X.one_scan_daily(table_, F.lit("corp.example"))


or_of = lambda names: "(" + "|".join(names) + ")"
DAILY_PARTS_SQL = f"""e AS (SELECT *, CAST(event_ts AS DATE) AS day, {LATE} AS ah, regexp_extract(lower(resource), '\\.(\\w+)$', 1) AS ext,
    CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS ext_n FROM ev),
  logon AS (SELECT "user", day, count(*) AS login_count, count(*) FILTER (ah) AS after_hours_count, count(DISTINCT ip_address) AS unique_pcs FROM e WHERE source = 'azure_ad' GROUP BY ALL),
  file AS (SELECT "user", day, count(*) AS files_accessed, count(*) FILTER (ext IN {tuple(P.TRAIN_ARCHIVE)}) AS n_archive_files, count(*) FILTER (ext IN {tuple(P.TRAIN_EXE)}) AS n_exe_files,
           count(*) FILTER (ah) AS n_afterhours_file FROM e WHERE source = 'cert_file' GROUP BY ALL),
  usb AS (SELECT "user", day, count(*) FILTER (k % 2 = 0) AS usb_events, count(*) FILTER (k % 2 = 0 AND ah) AS n_afterhours_usb, CAST(count(*) FILTER (k % 2 = 0) > 0 AS BIGINT) AS has_usb
          FROM e WHERE source = 'aws_cloudtrail' GROUP BY ALL),
  mail AS (SELECT "user", day, count(*) AS email_count, CAST(sum(CASE WHEN k % 4 = 0 THEN k ELSE 0 END) AS BIGINT) AS total_attachments, CAST(sum(ext_n) AS BIGINT) AS external_emails,
           count(*) FILTER (ah) AS n_afterhours_email, count(*) FILTER (k % 5 = 0) AS n_bcc_email FROM e WHERE source = 'github_events' GROUP BY ALL),
  web AS (SELECT "user", day, count(*) AS http_count, count(*) FILTER (regexp_matches(resource, '{or_of(P.TRAIN_SUSPICIOUS)}')) AS suspicious_http,
          count(*) FILTER (regexp_matches(resource, '{or_of(P.TRAIN_JOB)}')) AS n_job_site, count(*) FILTER (regexp_matches(resource, '{or_of(P.TRAIN_CLOUD)}')) AS n_cloud_storage,
          count(*) FILTER (ah) AS n_afterhours_http FROM e WHERE source = 'cert_http' GROUP BY ALL)"""
DAILY_SQL = f"""{DAILY_PARTS_SQL},
  spine AS (SELECT "user", day FROM logon UNION SELECT "user", day FROM file UNION SELECT "user", day FROM usb UNION SELECT "user", day FROM mail UNION SELECT "user", day FROM web),
  daily AS (SELECT "user", day, {', '.join(f'coalesce({c}, 0) AS {c}' for c in X.DAILY if c != 'usb_and_file')},
            CAST(coalesce(has_usb, 0) > 0 AND coalesce(files_accessed, 0) > 0 AS BIGINT) AS usb_and_file
            FROM spine LEFT JOIN logon USING ("user", day) LEFT JOIN file USING ("user", day) LEFT JOIN usb USING ("user", day) LEFT JOIN mail USING ("user", day) LEFT JOIN web USING ("user", day))"""


@query(f"WITH {EVENTS_SQL}, {DAILY_SQL} SELECT * FROM daily")
def daily_activity(spark, sf_dir) -> DataFrame:
    return daily(spark, sf_dir)


@query(f"WITH {EVENTS_SQL}, {DAILY_SQL} SELECT * FROM daily")
def merged_daily(spark, sf_dir) -> DataFrame:
    """The same features from a log of its own for each source, stacked and summed."""
    return X.merge_daily(daily_parts(spark, sf_dir), columns=X.DAILY)


HOUR_ONLY = "(hour(event_ts) < 7 OR hour(event_ts) >= 18)"
any_sql = lambda names: "regexp_matches(resource, '" + "|".join(n.replace(".", "\\.") for n in names) + "')"
after_dot = "CASE WHEN contains(resource, '.') THEN lower(list_last(string_split(resource, '.'))) ELSE '' END"


def script_sql() -> str:
    of = lambda source, more="true": f"CAST(count(*) FILTER (source = '{source}' AND {more}) AS BIGINT)"
    made = {
        "login_count": of("azure_ad"), "after_hours_count": of("azure_ad", HOUR_ONLY), "unique_pcs": "count(DISTINCT CASE WHEN source = 'azure_ad' THEN ip_address END)",
        "files_accessed": of("cert_file"), "n_archive_files": of("cert_file", f"{after_dot} IN {tuple(P.LIVE_ARCHIVE)}"), "n_exe_files": of("cert_file", f"{after_dot} = 'exe'"),
        "n_afterhours_file": of("cert_file", HOUR_ONLY), "usb_events": of("aws_cloudtrail"), "has_usb": of("aws_cloudtrail"), "n_afterhours_usb": of("aws_cloudtrail", HOUR_ONLY),
        "email_count": of("github_events"), "total_attachments": "CAST(coalesce(sum(CASE WHEN source = 'github_events' AND k % 4 = 0 THEN k END), 0) AS BIGINT)",
        "external_emails": of("github_events", "k % 3 = 0"), "n_afterhours_email": of("github_events", HOUR_ONLY), "n_bcc_email": of("github_events", "k % 5 = 0"), "http_count": of("cert_http"),
        "suspicious_http": of("cert_http", any_sql(P.LIVE_SUSPICIOUS)), "n_job_site": of("cert_http", any_sql(P.LIVE_JOB)), "n_cloud_storage": of("cert_http", any_sql(P.LIVE_CLOUD)),
        "n_afterhours_http": of("cert_http", HOUR_ONLY), "usb_and_file": "CAST(0 AS BIGINT)",
    }
    return ", ".join(f"{sql} AS {name}" for name, sql in made.items())


@query(f'WITH {EVENTS_SQL} SELECT "user", CAST(event_ts AS DATE) AS day, {script_sql()} FROM ev GROUP BY ALL')
def script_daily(spark, sf_dir) -> DataFrame:
    return X.script_daily(one_table(spark, sf_dir))


@query(f'WITH {EVENTS_SQL}, {DAILY_PARTS_SQL} SELECT "user", day, files_accessed, http_count FROM (SELECT "user", day FROM file UNION SELECT "user", day FROM web) LEFT JOIN file USING ("user", day) LEFT JOIN web USING ("user", day)'.replace("SELECT \"user\", day, files_accessed, http_count", 'SELECT "user", day, coalesce(files_accessed, 0) AS files_accessed, coalesce(http_count, 0) AS http_count'))
def user_day_spine_join(spark, sf_dir) -> DataFrame:
    """The spine of user-days and left joins, as the reference form of merge_daily()."""
    p = daily_parts(spark, sf_dir)
    spine = p[1].select("user", "day").union(p[4].select("user", "day")).distinct()
    joined = spine.join(p[1], ["user", "day"], "left").join(p[4], ["user", "day"], "left")
    return joined.fillna(0).select("user", "day", "files_accessed", "http_count")


@query(f'WITH {EVENTS_SQL}, {DAILY_PARTS_SQL} SELECT "user", day, login_count, email_count FROM logon FULL JOIN mail USING ("user", day)')
def user_day_outer_join(spark, sf_dir) -> DataFrame:
    p = daily_parts(spark, sf_dir)
    return p[0].join(p[3], ["user", "day"], "full_outer").select("user", "day", "login_count", "email_count")


PROFILE_SQL = 'profile AS (SELECT "user", ' + ", ".join(f"avg({c}) AS {c}_mean, max({c}) AS {c}_max, CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in X.DAILY) + ' FROM daily GROUP BY "user")'
PROFILE = [f"{c}_{s}" for c in X.DAILY for s in ("mean", "max", "sum")]


def profile(spark, sf_dir) -> DataFrame:
    return X.user_profile(daily(spark, sf_dir), X.DAILY)


@query(f"WITH {EVENTS_SQL}, {DAILY_SQL}, {PROFILE_SQL} SELECT \"user\", " + ", ".join(f"round({c}, 6) AS {c}" if c.endswith("mean") else c for c in PROFILE) + " FROM profile")
def user_profile_63(spark, sf_dir) -> DataFrame:
    return profile(spark, sf_dir).select("user", *[F.round(c, 6).alias(c) if c.endswith("mean") else F.col(c) for c in PROFILE])


BURST = ["files_accessed", "usb_events", "after_hours_count"]


@query(f"WITH {EVENTS_SQL}, {DAILY_SQL}, {PROFILE_SQL} SELECT \"user\", " + ", ".join(f"round(greatest(0, least(50, {c}_max / CASE WHEN {c}_mean = 0 THEN 0.001 ELSE {c}_mean END)), 6) AS {c}_burst_ratio" for c in BURST) + " FROM profile")
def burst_ratio(spark, sf_dir) -> DataFrame:
    return profile(spark, sf_dir).select("user", *[F.round(X.burst_ratio(F.col(f"{c}_max"), F.col(f"{c}_mean")), 6).alias(f"{c}_burst_ratio") for c in BURST])


@query(f'WITH {EVENTS_SQL}, {DAILY_SQL}, {PROFILE_SQL} SELECT "user", has_usb_sum * files_accessed_max AS usb_file_interaction FROM profile')
def usb_file_interaction(spark, sf_dir) -> DataFrame:
    return profile(spark, sf_dir).select("user", (F.col("has_usb_sum") * F.col("files_accessed_max")).alias("usb_file_interaction"))


LIVE_FEATURES = [c for c in X.DAILY if c != "unique_pcs"]


def live_events(spark, sf_dir) -> DataFrame:
    """The view as stored endpoint events with time texts and metadata; odd trail events are logons, even ones devices, and mails stand for hosting events."""
    e, k = events(spark, sf_dir), F.col("k")
    source = F.when(F.col("source") == "github_events", "cert_email").when(F.col("source") == "aws_cloudtrail", F.when(k % 2 == 0, "cert_device").otherwise("cert_logon")).otherwise(F.col("source"))
    texts = {
        "to": F.when(k % 3 == 0, "a@Other.example").when(k % 3 == 1, "c@corp.example"), "from": F.lit("z@corp.example"), "bcc": F.when(k % 5 == 0, "x@y.example"),
        "attachments": F.when(k % 4 == 0, k.cast("string")).otherwise("none.txt"), "to_removable_media": F.when(k % 6 == 0, "True").otherwise("False"),
        "from_removable_media": F.when(k % 6 == 1, "true"), "pc": F.col("ip_address"), "country": F.col("country"),
    }
    e = e.withColumns({"timestamp": F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "metadata": N.metadata(texts), "source": source})
    return X.event_features(e)


LIVE_SQL = f"""stored AS (SELECT * REPLACE (CASE WHEN source = 'github_events' THEN 'cert_email' WHEN source = 'aws_cloudtrail' AND k % 2 = 0 THEN 'cert_device'
      WHEN source = 'aws_cloudtrail' THEN 'cert_logon' ELSE source END AS source), strftime(event_ts, '%Y-%m-%d') AS day, (hour(event_ts) < 7 OR hour(event_ts) >= 18) AS late,
      regexp_extract(resource, '\\.([^.]*)$', 1) AS ext FROM ev),
  live AS (SELECT *, CAST(source IN ('cert_logon', 'azure_ad') AS INTEGER) AS login_count, CAST(source IN ('cert_logon', 'azure_ad') AND late AS INTEGER) AS after_hours_count,
    CAST(source = 'cert_file' AS INTEGER) AS files_accessed, CAST(source = 'cert_file' AND ext IN {tuple(P.LIVE_ARCHIVE)} AS INTEGER) AS n_archive_files,
    CAST(source = 'cert_file' AND ext = 'exe' AS INTEGER) AS n_exe_files, CAST(source = 'cert_file' AND late AS INTEGER) AS n_afterhours_file,
    CAST(source = 'cert_device' OR source = 'cert_file' AND k % 6 IN (0, 1) AS INTEGER) AS usb_events, CAST(source = 'cert_device' OR source = 'cert_file' AND k % 6 IN (0, 1) AS INTEGER) AS has_usb,
    CAST((source = 'cert_device' OR source = 'cert_file' AND k % 6 IN (0, 1)) AND late AS INTEGER) AS n_afterhours_usb,
    CAST(source = 'cert_email' AS INTEGER) AS email_count, CASE WHEN source = 'cert_email' AND k % 4 = 0 THEN k ELSE 0 END AS total_attachments,
    CAST(source = 'cert_email' AND k % 3 = 0 AS INTEGER) AS external_emails, CAST(source = 'cert_email' AND late AS INTEGER) AS n_afterhours_email,
    CAST(source = 'cert_email' AND k % 5 = 0 AS INTEGER) AS n_bcc_email,
    CAST(source = 'cert_http' AS INTEGER) AS http_count, CAST(source = 'cert_http' AND regexp_matches(resource, '{or_of(P.LIVE_SUSPICIOUS)}') AS INTEGER) AS suspicious_http,
    CAST(source = 'cert_http' AND regexp_matches(resource, '{or_of(P.LIVE_JOB)}') AS INTEGER) AS n_job_site,
    CAST(source = 'cert_http' AND regexp_matches(resource, '{or_of(P.LIVE_CLOUD)}') AS INTEGER) AS n_cloud_storage,
    CAST(source = 'cert_http' AND late AS INTEGER) AS n_afterhours_http, CAST(source = 'cert_file' AND k % 6 IN (0, 1) AS INTEGER) AS usb_and_file FROM stored)"""
VECTOR_SQL = f"""days AS (SELECT "user", day, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in LIVE_FEATURES)},
      count(DISTINCT CASE WHEN source = 'cert_logon' THEN coalesce(nullif(resource, ''), ip_address) END) AS unique_pcs FROM live GROUP BY ALL),
  users AS (SELECT "user", {', '.join(f'avg({c}) AS {c}_mean, max({c}) AS {c}_max, CAST(sum({c}) AS BIGINT) AS {c}_sum' for c in X.DAILY)} FROM days GROUP BY "user"),
  vector AS (SELECT *, {', '.join(f'least(50, {c}_max / greatest({c}_mean, 0.001)) AS {c}_burst_ratio' for c in X.BURSTS)}, has_usb_sum * files_accessed_max AS usb_file_interaction,
      {', '.join(f'{c} / greatest(1, coalesce(CASE WHEN peers < 7 THEN avg({c}) OVER (PARTITION BY peers) END, 1)) AS {c}_peer_ratio' for c in X.PEERS)} FROM (SELECT *, CAST("user" AS INTEGER) % 8 AS peers FROM users))"""


def is_ratio(name: str) -> bool:
    return name.endswith(("mean", "ratio"))


@query(f'WITH {EVENTS_SQL}, {LIVE_SQL}, {VECTOR_SQL} SELECT "user", {", ".join(f"round({c}, 6) AS {c}" if is_ratio(c) else c for c in X.VECTOR)} FROM vector')
def live_user_vector(spark, sf_dir) -> DataFrame:
    """The 71 features of each stored user, as the live scorer takes them; users are peers by their number, and those of the eighth group have none."""
    daily = cut(X.live_daily(live_events(spark, sf_dir)))
    group = F.col("user").cast("int") % 8
    users = X.user_profile(daily, X.DAILY).withColumn("peer_group", F.when(group < 7, group))
    vector = X.user_vector(daily, scoring.means_of_peers(users, X.PEERS))
    return vector.select("user", *[F.round(c, 6).alias(c) if is_ratio(c) else F.col(c) for c in X.VECTOR])


@query(f"""WITH {EVENTS_SQL}, {CLOUD_SQL}, a AS (SELECT DISTINCT "user", CAST(event_ts AS DATE) AS day, lower(trim(action)) AS act FROM ev),
    f AS (SELECT *, min(day) OVER (PARTITION BY "user", act) AS first_day FROM a), n AS (SELECT "user", day, count(*) FILTER (day = first_day AND act <> '') AS new_action_count FROM f GROUP BY ALL)
    SELECT "user", day, {', '.join(X.CLOUD)} FROM cloud JOIN n USING ("user", day) QUALIFY day = max(day) OVER (PARTITION BY "user")""")
def cloud_latest_day(spark, sf_dir) -> DataFrame:
    return X.cloud_latest_day(events(spark, sf_dir)).select("user", "day", *X.CLOUD)


@query(f'WITH {EVENTS_SQL}, {LIVE_SQL} SELECT event_id, {", ".join(LIVE_FEATURES)} FROM live')
def event_features(spark, sf_dir) -> DataFrame:
    return live_events(spark, sf_dir).select("event_id", *LIVE_FEATURES)


@query(f'WITH {EVENTS_SQL} SELECT "user", count(*) AS event_count, array_to_string(list_sort(list(DISTINCT source)), \',\') AS sources, max(event_ts) AS last_seen FROM ev GROUP BY "user"')
def user_sources_summary(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("user").agg(F.count(F.lit(1)).alias("event_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("event_ts").alias("last_seen"))


@query(f'WITH {EVENTS_SQL} SELECT hour(event_ts)::INTEGER AS hour, count(*) AS n, count(*) FILTER ({LATE}) AS after_hours FROM ev GROUP BY ALL')
def hour_histogram(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.hour("event_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(T.after_hours_train(F.col("event_ts"))).alias("after_hours"))


@query(f'WITH {EVENTS_SQL} SELECT "user", count(*) AS n FROM ev WHERE {LATE} GROUP BY "user" ORDER BY n DESC, "user" LIMIT 20')
def top_users_after_hours(spark, sf_dir) -> DataFrame:
    late = events(spark, sf_dir).filter(T.after_hours_train(F.col("event_ts")))
    return late.groupBy("user").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user").limit(20)


@query(f"""WITH {EVENTS_SQL}, {CLOUD_SQL} SELECT "user", count(*) AS active_days, CAST(sum(event_count) AS BIGINT) AS total_events, max(unique_actions) AS max_actions,
    round(avg(unique_ips), 6) AS mean_ips, round(avg(error_events), 6) AS mean_errors FROM cloud GROUP BY "user" """)
def cloud_user_rollup(spark, sf_dir) -> DataFrame:
    days = X.cloud_user_day(events(spark, sf_dir), with_new=False)
    return days.groupBy("user").agg(
        F.count(F.lit(1)).alias("active_days"), F.sum("event_count").alias("total_events"), F.max("unique_actions").alias("max_actions"),
        F.round(F.avg("unique_ips"), 6).alias("mean_ips"), F.round(F.avg("error_events"), 6).alias("mean_errors"),
    )


@query(f'WITH {EVENTS_SQL}, {CLOUD_SQL} SELECT count(DISTINCT "user") AS users, count(*) AS user_days, min(day) AS first_day, max(day) AS last_day, round(avg(CASE WHEN CAST("user" AS INTEGER) % 15 = 0 THEN 1.0 ELSE 0.0 END), 6) AS label_share FROM cloud')
def dataset_summary(spark, sf_dir) -> DataFrame:
    days = events(spark, sf_dir).select("user", F.to_date("event_ts").alias("day")).distinct()
    label = (F.col("user").cast("int") % 15 == 0).cast("double")
    return days.agg(F.countDistinct("user").alias("users"), F.count(F.lit(1)).alias("user_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.avg(label), 6).alias("label_share"))


@query(f'WITH {EVENTS_SQL} SELECT event_id, resource, regexp_matches(resource, \'(?i)({P.SENSITIVE_RESOURCE})\') AS sensitive FROM ev')
def sensitive_resource(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "resource", P.sensitive_resource(F.col("resource")).alias("sensitive"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, {OFF} AS off_hours FROM ev")
def off_hours(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", T.off_hours(F.col("event_ts")).alias("off_hours"))
