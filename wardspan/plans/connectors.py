"""Queries that write tables in the forms that logs come in, and read them with the library's readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions import texts as X
from wardspan.functions import times as T
from wardspan.operators import cases, catalog, features, normalize
from wardspan.operators.cuts import cut
from wardspan.plans.alerting import CASES_SQL, case_log
from wardspan.plans.named import query
from wardspan.plans.scores import SCORES_SQL, user_scores
from wardspan.sources import readers, sinks
from wardspan.sources.store import Store
from wardspan.sources.tables import EVENTS_SQL, events
from wardspan.streaming.streams import scratch


def text_of(e: DataFrame, form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'"):
    return F.date_format("event_ts", form)


def file_log(e: DataFrame) -> DataFrame:
    """The events as an endpoint's file log."""
    return e.select(
        F.col("event_id").cast("string").alias("id"), text_of(e, "MM/dd/yyyy HH:mm:ss").alias("date"), "user", F.col("ip_address").alias("pc"), F.col("resource").alias("filename"),
        F.col("action").alias("activity"), F.when(F.col("k") % 2 == 0, "True").otherwise("False").alias("to_removable_media"), F.lit("False").alias("from_removable_media"),
    )


@query(f"WITH {EVENTS_SQL} SELECT CAST(event_id AS VARCHAR) AS id, \"user\", nullif(resource, '') AS filename, strftime(event_ts, '%m/%d/%Y %H:%M:%S') AS date FROM ev")
def csv_log(spark, sf_dir) -> DataFrame:
    """A log with a heading in CSV files, of which four columns are read."""
    with scratch(spark) as folder:
        file_log(events(spark, sf_dir)).write.csv(folder, header=True)
        return cut(readers.cert_csv(spark, folder, "file", ["id", "user", "filename", "date"]))


@query(f"""WITH {EVENTS_SQL} SELECT "user", CAST(event_ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(k % 2 = 0 AS INTEGER)) AS BIGINT) AS removable FROM ev WHERE CAST("user" AS INTEGER) % 2 = 0 GROUP BY ALL""")
def csv_cohort_days(spark, sf_dir) -> DataFrame:
    """Sums by day of a cohort's rows in two folders of a log, broken lines left out."""
    e = events(spark, sf_dir)
    with scratch(spark) as folder:
        for i in range(2):
            file_log(e.filter(F.col("event_id") % 2 == i)).write.csv(f"{folder}/log/{i}", header=True)
        cohort = e.filter(F.col("user").cast("int") % 2 == 0).select("user")
        rows = readers.cert_csv(spark, [f"{folder}/log/0", f"{folder}/log/1"], "file", ["user", "date", "to_removable_media"], cohort)
        days = rows.select("user", F.to_date(T.parse_any(F.col("date"))).alias("day"), F.lit(1).alias("n"), (F.col("to_removable_media") == "True").cast("int").alias("removable"))
        return cut(features.sums(days, ["user", "day"], ["n", "removable"]))


@query(f"WITH {EVENTS_SQL} SELECT CAST(event_id % 3 AS INTEGER) AS part, least(40, count(*)) AS n FROM ev GROUP BY 1")
def limited_logs(spark, sf_dir) -> DataFrame:
    """At most 40 rows of each of three logs."""
    e = events(spark, sf_dir)
    with scratch(spark) as folder:
        paths = [f"{folder}/{i}" for i in range(3)]
        for i, p in enumerate(paths):
            file_log(e.filter(F.col("event_id") % 3 == i)).write.csv(p, header=True)
        rows = readers.limited(spark, paths, lambda s, p: readers.cert_csv(s, p, "file", ["id"]), 40)
        return cut(rows.groupBy((F.col("id").cast("long") % 3).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {EVENTS_SQL} SELECT CAST(event_id AS VARCHAR) AS id, action FROM ev")
def mixed_json(spark, sf_dir) -> DataFrame:
    """One folder with envelopes, packed arrays and lines of JSON; a third of the events each."""
    e = events(spark, sf_dir).withColumn("raw", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("action"))))
    listed = e.groupBy("user", F.to_date("event_ts").alias("day"), (F.col("event_id") % 3).alias("part")).agg(F.array_join(F.collect_list("raw"), ",").alias("rows"))
    with scratch(spark) as folder:
        put = lambda df, name, **how: df.write.text(f"{folder}/log/{name}", **how)
        put(listed.filter("part = 0").select(F.format_string('{"Source": "x", "Records": [%s]}', "rows")), "a")
        put(listed.filter("part = 1").select(F.format_string("[%s]", "rows")), "b", compression="gzip")
        put(e.filter("event_id % 3 = 2").select("raw"), "c")
        rename(spark, f"{folder}/log/a", ".txt", ".json")
        rename(spark, f"{folder}/log/b", ".txt.gz", ".json.gz")
        rename(spark, f"{folder}/log/c", ".txt", ".jsonl")
        raw = readers.any_events(spark, f"{folder}/log")
        return cut(raw.select(F.get_json_object("raw", "$.id").alias("id"), F.get_json_object("raw", "$.action").alias("action")))


def rename(spark, folder: str, old: str, new: str) -> None:
    """Gives a folder's files another extension."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(old):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(old) + new))


@query(f"""WITH {EVENTS_SQL} SELECT strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, "user", action, ip_address, CASE WHEN k % 3 = 0 THEN 'eu-west-1' ELSE 'us-east-1' END AS region FROM ev WHERE k % 5 > 0""")
def trail_csv(spark, sf_dir) -> DataFrame:
    """An export with a heading of its own, normalised; rows without a name of the event go, and a missing region is the usual one."""
    e, k = events(spark, sf_dir), F.col("k")
    rows = e.select(
        text_of(e).alias("Event Time"), F.when(k % 5 > 0, F.col("action")).alias("Event Name"), F.col("user").alias("User Name"), F.when(k % 3 == 0, "eu-west-1").alias("AWS Region"),
        F.col("ip_address").alias("Source IP Address"),
    )
    with scratch(spark) as folder:
        rows.write.csv(f"{folder}/export.csv", header=True)
        raw = readers.any_events(spark, f"{folder}/export.csv").withColumn("source", F.lit("aws_cloudtrail"))
        told = normalize.normalize(raw)
        return cut(told.select("timestamp", "user", "action", "ip_address", F.col("metadata")["awsRegion"].alias("region")))


@query(f"WITH {CASES_SQL} SELECT * FROM cases")
def saved_cases(spark, sf_dir) -> DataFrame:
    """The cases of a log of saves that was written in two parts."""
    log = case_log(spark, sf_dir)
    with scratch(spark) as folder:
        early = F.dayofmonth("saved_at") < 15
        cases.save(spark, f"{folder}/log", log.filter(early))
        cases.save(spark, f"{folder}/log", log.filter(~early))
        told = cases.records(cases.load(spark, f"{folder}/log"))
        return cut(told.select("user", "status", "notes", "created_at", "updated_at", F.size("history").alias("entries")))


@query(f"""WITH {CASES_SQL} SELECT "user", status, notes, entries FROM cases""")
def case_store(spark, sf_dir) -> DataFrame:
    """Cases as JSON objects by user, some with their history as text, read as rows again."""
    found = cases.records(case_log(spark, sf_dir)).withColumn("user_number", F.col("user").cast("int"))
    entries = F.transform("history", lambda h: F.struct(h.status.alias("status"), h.analyst.alias("analyst"), h.note.alias("note"), h.saved_at.cast("string").alias("timestamp")))
    as_text = F.to_json(F.struct(F.col("status"), F.col("notes"), F.to_json(entries).alias("history")))
    as_list = F.to_json(F.struct(F.col("status"), F.col("notes"), entries.alias("history")))
    each = found.select("user", F.concat(F.to_json(F.array("user")).substr(F.lit(2), F.length(F.to_json(F.array("user"))) - 2), F.lit(": "), F.when(F.col("user_number") % 2 == 0, as_text).otherwise(as_list)).alias("pair"))
    parts = each.groupBy(F.pmod(F.xxhash64("user"), F.lit(64)).alias("part")).agg(F.array_join(F.collect_list("pair"), ", ").alias("pairs"))
    with scratch(spark) as folder:
        parts.select(F.format_string("{%s}", "pairs").alias("value")).repartition(64, "value").write.option("lineSep", "\n").text(folder)
        told = cases.store_rows(spark.read.text(folder))
        return cut(told.select("user", "status", "notes", F.size("history").alias("entries")))


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT "user", arg_max(value, event_id) AS value, max(event_id) AS event_id FROM ev GROUP BY "user") SELECT * FROM l WHERE CAST("user" AS INTEGER) % 7 > 0""")
def live_upserts(spark, sf_dir) -> DataFrame:
    """Scores put in by three batches out of order, then some users deleted."""
    e = events(spark, sf_dir).select("user", "event_id", "value")
    with scratch(spark) as folder:
        for part in (1, 2, 0):
            sinks.upsert(spark, folder, e.filter(F.col("event_id") % 3 == part), ["user"], ["event_id"])
        store = Store(spark, folder, ["user"], ["event_id"])
        store.delete(e.filter(F.col("user").cast("int") % 7 == 0).select("user"))
        return cut(store.read())


@query(f"WITH {EVENTS_SQL} SELECT CAST(event_ts AS DATE) AS event_date, count(*) AS n, count(DISTINCT event_id) AS ids FROM ev GROUP BY 1")
def appended_days(spark, sf_dir) -> DataFrame:
    """Events appended in two parts to a table by day."""
    e = events(spark, sf_dir)
    with scratch(spark) as folder:
        for i in range(2):
            sinks.append_events(e.filter(F.col("event_id") % 2 == i), folder)
        return cut(spark.read.parquet(folder).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids")))


@query(f"""WITH {SCORES_SQL} SELECT "user", round(score, 6) AS score, label FROM scores""")
def scores_report(spark, sf_dir) -> DataFrame:
    """A report of scores with their labels, written as CSV and found by its headings."""
    rows = user_scores(spark, sf_dir).select(F.col("user").alias("user_id"), F.col("score").alias("ae_score"), F.col("label").alias("is_insider"))
    with scratch(spark) as folder:
        sinks.sorted_csv(rows, folder, "ae_score")
        return cut(readers.scores_csv(spark, folder).select("user", F.round("score", 6).alias("score"), "label"))


@query(f"""WITH {EVENTS_SQL} SELECT strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'u' || "user" AS "user", lower(trim(action)) || CASE WHEN k % 4 = 0 THEN ' (denied)' ELSE '' END AS action, resource, ip_address,
    nullif(country, '') AS country, 'cloudflare_access' AS source FROM ev""")
def access_events(spark, sf_dir) -> DataFrame:
    """The events as access logs: the action in lower case, and whether it was denied; where that isn't told it was allowed."""
    e, k = events(spark, sf_dir), F.col("k")
    raw = F.to_json(F.struct(
        text_of(e).alias("created_at"), F.concat(F.lit("u"), "user").alias("user_email"), F.concat(F.lit(" "), F.upper("action")).alias("action"), F.when(k % 4 == 0, F.lit(False)).when(k % 4 == 1, F.lit(True)).alias("allowed"),
        F.col("resource").alias("app_domain"), F.col("ip_address"), F.nullif("country", F.lit("")).alias("country"),
    ))
    told = normalize.normalize(e.select(F.lit("cloudflare_access").alias("source"), raw.alias("raw")))
    return told.select("timestamp", "user", "action", "resource", "ip_address", F.col("metadata")["country"].alias("country"), "source")


@query(f"""WITH {EVENTS_SQL} SELECT CASE k % 4 WHEN 0 THEN 'unknown source' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'not a JSON object' END AS error, count(*) AS n FROM ev WHERE k % 4 < 3 GROUP BY 1""")
def rejected_events(spark, sf_dir) -> DataFrame:
    """Unknown sources, broken texts and texts that aren't objects."""
    k = F.col("k")
    raw = F.when(k % 4 == 1, "{broken").when(k % 4 == 2, "[1]").otherwise("{}")
    rows = events(spark, sf_dir).select(F.when(k % 4 == 0, "nowhere").otherwise("cert_http").alias("source"), raw.alias("raw"))
    return normalize.rejects(rows).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, CASE k % 5 WHEN 0 THEN 'n' || "user" WHEN 1 THEN 'i' || "user" WHEN 2 THEN 's' || "user" ELSE 'Role' END AS name FROM ev""")
def cloud_identities(spark, sf_dir) -> DataFrame:
    """A stable name of four parts of an identity: sessions that are a number, or of 40 characters and more, are none."""
    k, user = F.col("k") % 5, F.col("user")
    name = X.cloud_user(
        F.when(k == 0, F.concat(F.lit("n"), user)).when(k == 4, F.lit("")), F.when(k == 1, F.concat(F.lit("i"), user)),
        F.concat(F.lit("ID:"), F.when(k == 2, F.concat(F.lit("s"), user)).when(k == 3, user).otherwise(F.repeat(F.lit("x"), 40))), F.lit("Role"),
    )
    return events(spark, sf_dir).select("event_id", name.alias("name"))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, * FROM events) SELECT 'g' || CAST(user_id AS VARCHAR) AS "user", count(*) AS n, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS first FROM a WHERE k % 3 < 2 GROUP BY 1""")
def actors(spark, sf_dir) -> DataFrame:
    """Source-hosting events by actor; events without one go."""
    e, k = events(spark, sf_dir), F.col("k") % 3
    name = F.concat(F.lit("g"), "user")
    actor = F.struct(F.when(k == 0, name).alias("login"), F.when(k == 1, name).alias("display_login"))
    told = readers.events_by_actor(e.select(F.to_json(F.struct(actor.alias("actor"), text_of(e).alias("created_at"))).alias("raw")))
    return told.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts) END AS parsed,
    CASE WHEN event_id % 6 < 3 THEN hour(ts) < 7 OR hour(ts) >= 18 ELSE event_id % 6 = 3 END AS late,
    CASE event_id % 6 WHEN 1 THEN CAST(ts - INTERVAL 330 MINUTE AS DATE) WHEN 4 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""")
def time_texts(spark, sf_dir) -> DataFrame:
    """Times as texts in six forms, the last no time but with a day in front."""
    e = events(spark, sf_dir)
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd'Tjunk'"]
    text = F.element_at(F.array(*[text_of(e, f) for f in forms]), (F.col("event_id") % 6 + 1).cast("int"))
    t = e.select("event_id", text.alias("t"))
    return t.select("event_id", T.parse_any(F.col("t")).alias("parsed"), T.after_hours_live(F.col("t")).alias("late"), T.utc_day(F.col("t")).alias("day"))


@query(f"""WITH {CASES_SQL}, s AS (SELECT DISTINCT "user", 'look at ' || "user" AS suggestion FROM ev WHERE CAST("user" AS INTEGER) % 2 = 0)
    SELECT coalesce(c."user", s."user") AS "user", coalesce(status, 'Pending') AS status, suggestion FROM cases c FULL JOIN s ON c."user" = s."user" """)
def case_suggestions(spark, sf_dir) -> DataFrame:
    """Texts attached to cases; users without one get a pending record."""
    told = events(spark, sf_dir).filter(F.col("user").cast("int") % 2 == 0).select("user").distinct().withColumn("suggestion", F.concat(F.lit("look at "), "user"))
    return cases.with_suggestions(cases.records(case_log(spark, sf_dir)).select("user", "status"), told).select("user", "status", "suggestion")


@query("""WITH a AS (SELECT 'USR-' || upper(substr(sha256('salt:' || CAST(user_id AS VARCHAR)), 1, 8)) AS "user", * FROM events), l AS (SELECT 'USR-' || upper(substr(sha256('salt:' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS "user", c_nationkey FROM customer)
    SELECT "user", count(*) AS n, any_value(c_nationkey) AS c_nationkey FROM a JOIN l USING ("user") GROUP BY 1""")
def anonymise_tables(spark, sf_dir) -> DataFrame:
    """Two tables made anonymous with one salt still meet."""
    tables = {"events": events(spark, sf_dir).select("user"), "customer": spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("user"), "c_nationkey")}
    told = X.anonymise(tables, {"events": ["user"], "customer": ["user"]}, "salt")
    return told["events"].join(told["customer"], "user").groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.first("c_nationkey").alias("c_nationkey"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT "user", source, count(*) AS n FROM ev GROUP BY ALL) SELECT "user", source FROM n QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY n DESC, source) = 1""")
def user_primary_source(spark, sf_dir) -> DataFrame:
    return catalog.primary_source(events(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT "user" FROM ev GROUP BY 1 ORDER BY count(*) DESC, "user" LIMIT 1) SELECT event_id, action, event_ts FROM ev WHERE "user" = (SELECT "user" FROM u) ORDER BY event_ts DESC, event_id DESC LIMIT 20""")
def user_feed(spark, sf_dir) -> DataFrame:
    """The newest events of the busiest user, from an event store."""
    e = events(spark, sf_dir)
    busiest = e.groupBy("user").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user").first()
    with scratch(spark) as folder:
        store = sinks.event_store(spark, folder, 16)
        store.write(e.withColumn("ingested_at", F.col("event_ts")))
        rows = store.read_key(user=busiest["user"]) if busiest else e
        return cut(catalog.user_events(rows, busiest["user"] if busiest else "").select("event_id", "action", "event_ts"))


@query(f"""WITH {CASES_SQL} SELECT count(*) AS n, count(DISTINCT status) AS kinds, 'ok' AS status, (SELECT count(DISTINCT "user") FROM ev) AS live_users, count(*) AS batch_users FROM cases""")
def health(spark, sf_dir) -> DataFrame:
    """Whether batch and live users are there, and the cases by status."""
    found = cut(cases.records(case_log(spark, sf_dir)))
    told = catalog.health(found, events(spark, sf_dir).select("user").distinct())
    return told.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("status").alias("kinds")))).select("n", "kinds", "status", "live_users", "batch_users")


KINDS = [*normalize.HOSTING_ACTIONS, "OtherEvent"]
HOSTING_SQL = " ".join(f"WHEN '{kind}' THEN '{shown}'" for kind, shown in normalize.HOSTING_ACTIONS.items())


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT *, {KINDS}[k % {len(KINDS)} + 1] AS kind, ['opened', 'closed', NULL][k % 3 + 1] AS verb FROM ev)
    SELECT event_id, 'g' || "user" AS "user", 'o/r' || k AS resource, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN kind = 'PullRequestEvent' AND verb IS NOT NULL THEN 'PR ' || verb
      WHEN kind = 'IssuesEvent' AND verb IS NOT NULL THEN 'Issue ' || verb WHEN kind = 'PushEvent' THEN 'Code push (' || (k % 4) || CASE WHEN k % 4 = 1 THEN ' commit)' ELSE ' commits)' END
      ELSE CASE kind {HOSTING_SQL} ELSE kind END END AS action FROM t""")
def hosting_events(spark, sf_dir) -> DataFrame:
    """Source-hosting events of every known type and of an unknown one; pushes with the number of commits, requests and issues with what was done."""
    e, k = events(spark, sf_dir), F.col("k")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    payload = F.struct(at(["opened", "closed", None]).alias("action"), (k % 4).alias("size"))
    raw = F.to_json(F.struct(
        at(KINDS).alias("type"), F.struct(F.concat(F.lit("g"), "user").alias("login")).alias("actor"), F.struct(F.concat(F.lit("o/r"), k.cast("string")).alias("name")).alias("repo"), payload.alias("payload"),
        text_of(e).alias("created_at"),
    ))
    told = normalize.normalize(e.select("event_id", F.lit("github_events").alias("source"), raw.alias("raw")))
    return told.select("event_id", "user", "resource", "timestamp", "action")


@query(f"""WITH {EVENTS_SQL} SELECT CASE k % 9 {" ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(normalize.NORMALISERS))} END AS source, count(*) AS n, count(DISTINCT CASE WHEN k % 9 < 3 OR k % 9 = 8 THEN 'c' || "user" ELSE "user" END) AS users FROM ev GROUP BY 1""")
def all_sources(spark, sf_dir) -> DataFrame:
    """Events of all nine sources in one plan."""
    e = events(spark, sf_dir)
    name = F.concat(F.lit("c"), "user")
    raw = {
        "aws_cloudtrail": F.struct(F.struct(name.alias("userName")).alias("userIdentity"), F.col("action").alias("eventName")),
        "azure_ad": F.struct(name.alias("userPrincipalName")),
        "cloudflare_access": F.struct(name.alias("user_email")),
        "github_events": F.struct(F.struct(name.alias("login")).alias("actor")),
    }
    told, source = F.to_json(F.struct("user", text_of(e, "MM/dd/yyyy HH:mm:ss").alias("date"))), F.lit(None)
    for i, kind in enumerate(normalize.NORMALISERS):
        source = F.when(F.col("k") % 9 == i, kind).otherwise(source)
        told = F.when(F.col("k") % 9 == i, F.to_json(raw[kind])).otherwise(told) if kind in raw else told
    return normalize.normalize(e.select(source.alias("source"), told.alias("raw"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))
