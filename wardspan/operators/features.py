"""Features of events, user-days and users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions import patterns as P
from wardspan.functions import texts as X
from wardspan.functions import times as T

# Features of a user-day, and of a cloud user-day.
DAILY = [
    "login_count", "after_hours_count", "unique_pcs", "files_accessed", "n_archive_files", "n_exe_files", "n_afterhours_file", "usb_events", "has_usb",
    "n_afterhours_usb", "email_count", "total_attachments", "external_emails", "n_afterhours_email", "n_bcc_email", "http_count", "suspicious_http",
    "n_job_site", "n_cloud_storage", "n_afterhours_http", "usb_and_file",
]
CLOUD = [
    "event_count", "unique_actions", "unique_resources", "unique_ips", "after_hours_events", "sensitive_events", "error_events", "new_action_count",
    "iam_sts_events", "data_exfil_events", "admin_events", "assume_role_events",
]
LOCAL_ADDRESSES = ["127.0.0.1", "::1", ""]
LOGON_SOURCES = ["cert_logon", "aws_cloudtrail", "azure_ad", "cloudflare_access"]


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def event_features(df: DataFrame, after_hours: Column | None = None) -> DataFrame:
    """Live dialect: one INT column per feature that an event raises; metadata is a map of texts."""
    late = (T.after_hours_live(F.col("timestamp")) if after_hours is None else after_hours).cast("int")
    is_source = lambda *s: F.col("source").isin(*s).cast("int")
    of = lambda k: F.col("metadata")[k]
    resource = F.lower(F.coalesce("resource", F.lit("")))
    file, device, mail, web = is_source("cert_file"), is_source("cert_device"), is_source("cert_email"), is_source("cert_http")
    ext = X.extension_live(resource)
    media = file * F.coalesce((F.lower(of("to_removable_media")) == "true") | (F.lower(of("from_removable_media")) == "true"), F.lit(False)).cast("int")
    return df.withColumns(
        {
            "login_count": is_source(*LOGON_SOURCES),
            "after_hours_count": is_source(*LOGON_SOURCES) * late,
            "files_accessed": file,
            "n_afterhours_file": file * late,
            "n_archive_files": file * ext.isin(P.LIVE_ARCHIVE).cast("int"),
            "n_exe_files": file * (ext == "exe").cast("int"),
            "usb_events": media + device,
            "has_usb": media + device,
            "usb_and_file": media,
            "n_afterhours_usb": (media + device) * late,
            "email_count": mail,
            "n_afterhours_email": mail * late,
            "external_emails": mail * F.coalesce(X.any_external(of("to"), F.coalesce(of("from"), F.lit("@"))), F.lit(0)),
            "n_bcc_email": mail * of("bcc").isNotNull().cast("int"),
            "total_attachments": mail * X.number_or_zero(of("attachments")),
            "http_count": web,
            "n_afterhours_http": web * late,
            "n_job_site": web * P.any_of(resource, P.LIVE_JOB).cast("int"),
            "n_cloud_storage": web * P.any_of(resource, P.LIVE_CLOUD).cast("int"),
            "suspicious_http": web * P.any_of(resource, P.LIVE_SUSPICIOUS).cast("int"),
        }
    )


def logon_daily(df: DataFrame) -> DataFrame:
    """Of logons (id, user, day, after_hours, pc)."""
    return df.groupBy("user", "day").agg(
        F.count("id").alias("login_count"), count_where(F.col("after_hours")).alias("after_hours_count"), F.countDistinct("pc").alias("unique_pcs")
    )


def file_daily(df: DataFrame) -> DataFrame:
    """Of file events (id, user, day, after_hours, filename)."""
    ext = X.extension(F.col("filename"))
    return df.groupBy("user", "day").agg(
        F.count("id").alias("files_accessed"), count_where(ext.isin(P.TRAIN_ARCHIVE)).alias("n_archive_files"),
        count_where(ext.isin(P.TRAIN_EXE)).alias("n_exe_files"), count_where(F.col("after_hours")).alias("n_afterhours_file"),
    )


def usb_daily(df: DataFrame) -> DataFrame:
    """Of device events (user, day, after_hours, activity); only connections count."""
    connect = F.col("activity") == "Connect"
    out = df.groupBy("user", "day").agg(count_where(connect).alias("usb_events"), count_where(connect & F.col("after_hours")).alias("n_afterhours_usb"))
    return out.withColumn("has_usb", (F.col("usb_events") > 0).cast("long"))


def email_daily(df: DataFrame, company: Column) -> DataFrame:
    """Of mails (id, user, day, after_hours, to, bcc, attachments)."""
    return df.groupBy("user", "day").agg(
        F.count("id").alias("email_count"), F.sum(X.number_or_zero(F.col("attachments"))).alias("total_attachments"),
        F.sum(X.external_recipients(F.col("to"), company)).alias("external_emails"), count_where(F.col("after_hours")).alias("n_afterhours_email"),
        count_where(F.col("bcc").isNotNull()).alias("n_bcc_email"),
    )


def http_daily(df: DataFrame) -> DataFrame:
    """Of page visits (id, user, day, after_hours, url)."""
    of = lambda names: count_where(P.any_of(F.coalesce("url", F.lit("")), names, escape=False))
    return df.groupBy("user", "day").agg(
        F.count("id").alias("http_count"), of(P.TRAIN_SUSPICIOUS).alias("suspicious_http"), of(P.TRAIN_JOB).alias("n_job_site"),
        of(P.TRAIN_CLOUD).alias("n_cloud_storage"), count_where(F.col("after_hours")).alias("n_afterhours_http"),
    )


def one_scan_daily(df: DataFrame, company: Column) -> DataFrame:
    """DAILY features of all endpoint logs in one table: kind (logon, file, device, email or http), id, user, day, after_hours and their own columns.

    One aggregation over one scan; a user and day without events of a kind have 0 for it.
    """
    is_a = lambda kind: F.col("kind") == kind
    late = F.coalesce(F.col("after_hours"), F.lit(False))
    ext, connect = X.extension(F.col("filename")), F.coalesce(F.col("activity") == "Connect", F.lit(False))
    url = lambda names: P.any_of(F.coalesce("url", F.lit("")), names, escape=False)
    total = lambda kind, value: F.coalesce(F.sum(F.when(is_a(kind), value)), F.lit(0)).cast("long")
    counts = {
        "login_count": is_a("logon"), "after_hours_count": is_a("logon") & late, "files_accessed": is_a("file"), "n_archive_files": is_a("file") & ext.isin(P.TRAIN_ARCHIVE),
        "n_exe_files": is_a("file") & ext.isin(P.TRAIN_EXE), "n_afterhours_file": is_a("file") & late, "usb_events": is_a("device") & connect, "n_afterhours_usb": is_a("device") & connect & late,
        "email_count": is_a("email"), "n_afterhours_email": is_a("email") & late, "n_bcc_email": is_a("email") & F.col("bcc").isNotNull(), "http_count": is_a("http"),
        "suspicious_http": is_a("http") & url(P.TRAIN_SUSPICIOUS), "n_job_site": is_a("http") & url(P.TRAIN_JOB), "n_cloud_storage": is_a("http") & url(P.TRAIN_CLOUD),
        "n_afterhours_http": is_a("http") & late,
    }
    out = df.groupBy("user", "day").agg(
        *[count_where(c).alias(n) for n, c in counts.items()], F.countDistinct(F.when(is_a("logon"), F.col("pc"))).alias("unique_pcs"),
        total("email", X.number_or_zero(F.col("attachments"))).alias("total_attachments"), total("email", X.external_recipients(F.col("to"), company)).alias("external_emails"),
    )
    out = out.withColumn("has_usb", (F.col("usb_events") > 0).cast("long"))
    return out.withColumn("usb_and_file", F.col("has_usb") * (F.col("files_accessed") > 0).cast("long")).select("user", "day", *DAILY)


def script_daily(df: DataFrame) -> DataFrame:
    """DAILY features in the extraction script's dialect, of the table that one_scan_daily() takes with ``ts`` instead of day and after_hours, and ``from``.

    After hours is the hour alone; any activity with "connect" in any case counts,
    so Disconnect too, and each such event adds to has_usb; external mails count
    once; sites and archives are those of the live dialect, an executable is .exe;
    a blank bcc is none; usb_and_file is 0. Rows without a time go.
    """
    is_a = lambda kind: F.col("kind") == kind
    late = T.after_hours_script(F.col("ts"))
    usb = is_a("device") & F.contains(F.lower(F.coalesce("activity", F.lit(""))), F.lit("connect"))
    ext, url = X.extension_live(F.lower(F.coalesce("filename", F.lit("")))), F.lower(F.coalesce("url", F.lit("")))
    external = X.any_external(F.col("to"), F.coalesce("from", F.lit("")), split=True)
    counts = {
        "login_count": is_a("logon"), "after_hours_count": is_a("logon") & late, "files_accessed": is_a("file"), "n_archive_files": is_a("file") & ext.isin(P.LIVE_ARCHIVE),
        "n_exe_files": is_a("file") & (ext == "exe"), "n_afterhours_file": is_a("file") & late, "usb_events": usb, "has_usb": usb, "n_afterhours_usb": usb & late, "email_count": is_a("email"),
        "external_emails": is_a("email") & (external == 1), "n_afterhours_email": is_a("email") & late, "n_bcc_email": is_a("email") & (F.trim(F.coalesce("bcc", F.lit(""))) != ""),
        "http_count": is_a("http"), "suspicious_http": is_a("http") & P.any_of(url, P.LIVE_SUSPICIOUS), "n_job_site": is_a("http") & P.any_of(url, P.LIVE_JOB),
        "n_cloud_storage": is_a("http") & P.any_of(url, P.LIVE_CLOUD), "n_afterhours_http": is_a("http") & late,
    }
    out = df.filter(F.col("ts").isNotNull()).groupBy("user", F.to_date("ts").alias("day")).agg(
        *[count_where(c).alias(n) for n, c in counts.items()], F.countDistinct(F.when(is_a("logon"), F.coalesce("pc", F.lit("")))).alias("unique_pcs"),
        F.coalesce(F.sum(F.when(is_a("email"), X.number_or_zero(F.col("attachments")))), F.lit(0)).cast("long").alias("total_attachments"), F.lit(0).cast("long").alias("usb_and_file"),
    )
    return out.select("user", "day", *DAILY)


def live_daily(df: DataFrame) -> DataFrame:
    """A stored user's day sums of event_features(), by the first ten characters of the time text; unique_pcs counts the day's logon machines.

    Rows without a time text go. Of has_usb and usb_and_file a day has the sum.
    """
    pc = F.coalesce(F.nullif(F.col("resource"), F.lit("")), F.nullif(F.col("metadata")["pc"], F.lit("")))
    summed = [c for c in DAILY if c != "unique_pcs"]
    days = df.withColumn("day", T.raw_day_key(F.col("timestamp"))).filter("day <> ''")
    out = days.groupBy("user", "day").agg(*[F.sum(c).cast("long").alias(c) for c in summed], F.countDistinct(F.when(F.col("source") == "cert_logon", pc)).alias("unique_pcs"))
    return out.select("user", "day", *DAILY)


BURSTS = ["files_accessed", "usb_events", "after_hours_count"]
PEERS = ["login_count_sum", "files_accessed_sum", "usb_events_sum", "email_count_sum"]
#: The 71 features of a user in the model's order.
VECTOR = [*[f"{c}_{s}" for c in DAILY for s in ("mean", "max", "sum")], *[f"{c}_burst_ratio" for c in BURSTS], "usb_file_interaction", *[f"{c}_peer_ratio" for c in PEERS]]


def user_vector(daily: DataFrame, peer_means: DataFrame | None = None) -> DataFrame:
    """VECTOR of each user of user-days; peer_means (user, and a mean for each of PEERS) are 1 where absent, and at least 1."""
    out = user_profile(daily, DAILY)
    out = out.withColumns({f"{c}_burst_ratio": burst_ratio(F.col(f"{c}_max"), F.col(f"{c}_mean"), floor=True) for c in BURSTS})
    out = out.withColumn("usb_file_interaction", F.col("has_usb_sum") * F.col("files_accessed_max"))
    if peer_means is None:
        told, mean = out, lambda c: F.lit(1.0)
    else:
        told = out.join(peer_means.select("user", *[F.col(c).alias(f"{c}_of_peers") for c in PEERS]), "user", "left")
        mean = lambda c: F.greatest(F.coalesce(f"{c}_of_peers", F.lit(1.0)), F.lit(1.0))
    return told.withColumns({f"{c}_peer_ratio": F.col(c) / mean(c) for c in PEERS}).select("user", *VECTOR)


def merge_daily(parts: list[DataFrame], keys=("user", "day"), columns: list[str] | None = None) -> DataFrame:
    """All user-days with all parts' features, 0 where a part has none.

    Parts are stacked and summed in one aggregation instead of a chain of joins:
    a part has a key once, so its sum is its value.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in stacked.columns if c not in keys]
    out = stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    if {"has_usb", "files_accessed"} <= set(names):
        out = out.withColumn("usb_and_file", ((F.col("has_usb") > 0) & (F.col("files_accessed") > 0)).cast("long"))
    return out.select(*keys, *columns) if columns else out


def sums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in columns])


def user_profile(daily: DataFrame, columns: list[str], key: str = "user") -> DataFrame:
    """Mean over active days, maximum and sum of each feature."""
    stats = {"mean": F.avg, "max": F.max, "sum": F.sum}
    return daily.groupBy(key).agg(*[f(c).alias(f"{c}_{s}") for c in columns for s, f in stats.items()])


def burst_ratio(top: Column, mean: Column, floor: bool = False) -> Column:
    """Maximum over mean, at most 50; a mean of 0 (with floor, any below) counts as 0.001."""
    mean = F.greatest(mean, F.lit(0.001)) if floor else F.when(mean == 0, 0.001).otherwise(mean)
    return F.greatest(F.lit(0.0), F.least(F.lit(50.0), top / mean))


def cloud_user_day(df: DataFrame, with_new: bool = True) -> DataFrame:
    """Twelve features of each user and UTC day of events (user, event_ts, action, resource, ip_address).

    new_action_count counts a day's actions that no earlier day of the user has.
    It comes of each action's first day, a minimum that is summed up before the
    shuffle, so no history is collected or sorted.
    """
    action, resource, ip = F.lower(F.trim("action")), F.trim("resource"), F.trim("ip_address")
    flags = P.cloud_flags(F.col("action"), F.col("resource"))
    day = F.to_date("event_ts").alias("day")
    out = df.groupBy("user", day).agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct(action).alias("unique_actions"), F.countDistinct(F.nullif(resource, F.lit(""))).alias("unique_resources"),
        F.countDistinct(F.when(~ip.isin(LOCAL_ADDRESSES), ip)).alias("unique_ips"), count_where(T.off_hours(F.col("event_ts"))).alias("after_hours_events"),
        *[count_where(c).alias(n) for n, c in flags.items()],
    )
    if with_new:
        first = df.filter(action != "").groupBy("user", action.alias("act")).agg(F.min(day).alias("day"))
        new = first.groupBy("user", "day").agg(F.count(F.lit(1)).alias("new_action_count"))
        out = out.join(new, ["user", "day"], "left").withColumn("new_action_count", F.coalesce("new_action_count", F.lit(0)).cast("long"))
    return out.select("user", "day", *[c for c in CLOUD if with_new or c != "new_action_count"])


def cloud_latest_day(df: DataFrame) -> DataFrame:
    """CLOUD features of each user's latest UTC day, with all earlier days as history; users without a timed event have none."""
    days = cloud_user_day(df.filter(F.col("event_ts").isNotNull()))
    fields = [c for c in days.columns if c not in ("user", "day")]
    return days.groupBy("user").agg(F.max(F.struct("day", *fields)).alias("l")).select("user", "l.*")
