"""The nine normalisers: raw JSON events to eight fields.

Each takes the parsed event, a variant, and gives the seven fields as columns;
``normalize`` parses a text once, chooses by source and sends unknown sources and
texts that aren't objects to a reject output instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.texts import first_filled

FIELDS = ["timestamp", "user", "source", "action", "resource", "ip_address", "metadata"]
# What source-hosting event types are called.
HOSTING_ACTIONS = {
    "PushEvent": "Code push", "CreateEvent": "Branch/tag created", "DeleteEvent": "Branch/tag deleted", "PullRequestEvent": "Pull request",
    "IssuesEvent": "Issue activity", "IssueCommentEvent": "Issue comment", "ForkEvent": "Repository forked", "WatchEvent": "Repository starred",
    "ReleaseEvent": "Release published", "MemberEvent": "Member change", "PublicEvent": "Repository made public", "GollumEvent": "Wiki updated",
    "CommitCommentEvent": "Commit comment", "PullRequestReviewEvent": "PR review",
}
# Keys of raw events that become metadata.
AWS_KEYS = ["eventID", "eventSource", "awsRegion", "userAgent", "errorCode", "errorMessage", "userIdentity"]
AZURE_KEYS = [
    "id", "Id", "CorrelationId", "correlationId", "conditionalAccessStatus", "riskDetail", "riskLevelAggregated", "status", "Result", "clientAppUsed",
    "deviceDetail", "location", "UserAgent", "Category", "LoggedByService", "AADOperationType", "Type", "SourceSystem",
]
ACCESS_KEYS = ["country", "app_uid", "ray_id", "user_id", "app_type"]
EMAIL_KEYS = ["id", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"]


def field(raw: Column, *path: str) -> Column:
    """The text of a path in a variant, null if missing; of objects and arrays their JSON, with keys in order."""
    return F.try_variant_get(raw, "$" + "".join(f".{p}" if not p.startswith("[") else p for p in path), "string")


def metadata(pairs: dict[str, Column]) -> Column:
    """A map without the null values."""
    entries = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*[v.cast("string") for v in pairs.values()]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def keys_of(raw: Column, keys: list[str]) -> dict[str, Column]:
    return {k: field(raw, k) for k in keys}


def fields(source: str, timestamp, user, action, resource, ip_address=None, extra: dict[str, Column] | None = None) -> dict[str, Column]:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    return {
        "timestamp": text(timestamp), "user": text(user), "source": F.lit(source), "action": text(action), "resource": text(resource),
        "ip_address": text(ip_address), "metadata": metadata(extra or {}),
    }


def aws_cloudtrail(raw: Column) -> dict[str, Column]:
    at = lambda *p: field(raw, *p)
    parameters = F.when(~at("requestParameters").isin("{}", ""), at("requestParameters"))
    names = [at("requestParameters", k) for k in ("bucketName", "resourceArn", "instanceId", "roleName", "functionName")]
    user = first_filled(*[at("userIdentity", k) for k in ("userName", "principalId", "arn")])
    return fields("aws_cloudtrail", at("eventTime"), user, at("eventName"), first_filled(*names, parameters), at("sourceIPAddress"), keys_of(raw, AWS_KEYS))


def azure_ad(raw: Column) -> dict[str, Column]:
    # Diagnostic logs nest the fields under properties, which then go first.
    at = lambda *p: F.coalesce(field(raw, "properties", *p), field(raw, *p))
    initiator, targets, place = at("InitiatedBy"), at("TargetResources"), at("location")  # objects, or texts of objects
    user = first_filled(
        *[at(k) for k in ("userPrincipalName", "InitiatingUserOrApp", "InitiatingUser", "AccountUpn", "AccountName")],
        F.get_json_object(initiator, "$.user.userPrincipalName"), F.get_json_object(initiator, "$.app.displayName"),
    )
    resource = first_filled(
        *[at(k) for k in ("resourceDisplayName", "targetDisplayName", "FileName", "RemoteUrl")],
        F.get_json_object(targets, "$[0].displayName"), F.get_json_object(targets, "$[0].id"),
    )
    is_object = place.startswith("{")
    country = F.nullif(F.when(is_object, first_filled(F.get_json_object(place, "$.countryOrRegion"), F.get_json_object(place, "$.country"))).otherwise(place), F.lit(""))
    return fields(
        "azure_ad",
        first_filled(*[at(k) for k in ("createdDateTime", "ActivityDateTime", "TimeGenerated", "Timestamp", "time")]),
        user,
        first_filled(*[at(k) for k in ("appDisplayName", "ActivityDisplayName", "OperationName", "ActionType", "Category")]),
        resource,
        first_filled(*[at(k) for k in ("ipAddress", "IPAddress", "RemoteIP", "callerIpAddress")]),
        {k: at(k) for k in AZURE_KEYS} | {"country": country},
    )


def cloudflare_access(raw: Column) -> dict[str, Column]:
    kind = F.trim(F.lower(F.coalesce(field(raw, "action"), F.lit("access"))))
    denied = F.coalesce(field(raw, "allowed"), F.lit("true")).isin("false", "0", "")
    action = F.when(denied, F.concat(kind, F.lit(" (denied)"))).otherwise(kind)
    return fields("cloudflare_access", field(raw, "created_at"), field(raw, "user_email"), action, field(raw, "app_domain"), field(raw, "ip_address"), keys_of(raw, ACCESS_KEYS))


def cert(raw: Column, source: str, action: Column, resource: Column, keys: list[str]) -> dict[str, Column]:
    return fields(source, field(raw, "date"), field(raw, "user"), action, resource, None, keys_of(raw, keys))


def prefixed(raw: Column, prefix: str, otherwise: str) -> Column:
    activity = F.nullif(field(raw, "activity"), F.lit(""))
    return F.coalesce(F.concat(F.lit(f"{prefix}:"), activity), F.lit(otherwise))


def cert_logon(raw: Column) -> dict[str, Column]:
    return cert(raw, "cert_logon", prefixed(raw, "Logon", "Logon"), field(raw, "pc"), ["id", "pc"])


def cert_file(raw: Column) -> dict[str, Column]:
    return cert(raw, "cert_file", F.coalesce(field(raw, "activity"), F.lit("File Activity")), field(raw, "filename"), ["id", "pc", "to_removable_media", "from_removable_media"])


def cert_device(raw: Column) -> dict[str, Column]:
    return cert(raw, "cert_device", prefixed(raw, "Device", "Device Activity"), field(raw, "pc"), ["id", "pc"])


def cert_email(raw: Column) -> dict[str, Column]:
    to = F.nullif(field(raw, "to"), F.lit(""))
    return cert(raw, "cert_email", F.coalesce(field(raw, "activity"), F.lit("Send Email")), F.coalesce(F.concat(F.lit("email→"), to), F.lit("email")), EMAIL_KEYS)


def cert_http(raw: Column) -> dict[str, Column]:
    return cert(raw, "cert_http", F.coalesce(field(raw, "activity"), F.lit("HTTP Request")), field(raw, "url"), ["id", "pc", "content"])


def github_events(raw: Column) -> dict[str, Column]:
    kind, verb = F.coalesce(field(raw, "type"), F.lit("")), F.nullif(field(raw, "payload", "action"), F.lit(""))
    label = kind
    for name, shown in HOSTING_ACTIONS.items():
        label = F.when(kind == name, shown).otherwise(label)
    size = F.coalesce(field(raw, "payload", "size").try_cast("int"), F.lit(0))
    action = (
        F.when((kind == "PullRequestEvent") & verb.isNotNull(), F.concat(F.lit("PR "), verb))
        .when((kind == "IssuesEvent") & verb.isNotNull(), F.concat(F.lit("Issue "), verb))
        .when(kind == "PushEvent", F.concat(F.lit("Code push ("), size.cast("string"), F.when(size == 1, " commit)").otherwise(" commits)")))
        .otherwise(label)
    )
    extra = {
        "event_id": F.coalesce(field(raw, "id"), F.lit("")),
        "public": F.coalesce(field(raw, "public"), F.lit("true")),
        "ref": F.nullif(field(raw, "payload", "ref"), F.lit("")),
        "commits": field(raw, "payload", "size"),
        "actor_id": F.nullif(field(raw, "actor", "id"), F.lit("")),
    }
    user = first_filled(field(raw, "actor", "login"), field(raw, "actor", "display_login"))
    return fields("github_events", field(raw, "created_at"), user, action, field(raw, "repo", "name"), None, extra)


NORMALISERS = {f.__name__: f for f in (aws_cloudtrail, azure_ad, cloudflare_access, cert_logon, cert_file, cert_device, cert_email, cert_http, github_events)}


def valid(df: DataFrame, source: str = "source", raw: str = "raw") -> Column:
    """Whether an event's source is known and its text is a JSON object."""
    is_object = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{")
    return F.coalesce(F.col(source).isin(*NORMALISERS) & is_object, F.lit(False))


def normalize(df: DataFrame, source: str = "source", raw: str = "raw") -> DataFrame:
    """The events' eight fields, and the other columns of df; one pass whatever the sources, and each text is parsed once.

    Every field has a CASE of its own, so fields that nobody reads are never made.
    """
    known = df.filter(F.col(source).isin(*NORMALISERS) & F.trim(raw).startswith("{"))
    parsed = known.withColumn("parsed_", F.try_parse_json(raw)).filter(F.col("parsed_").isNotNull())
    made = {name: parser(F.col("parsed_")) for name, parser in NORMALISERS.items()}

    def of(field_: str) -> Column:
        out = F.lit(None)
        for name, columns in made.items():
            out = F.when(F.col(source) == name, columns[field_]).otherwise(out)
        return out

    return parsed.withColumns({f: of(f) for f in FIELDS if f != "source"}).drop("parsed_")


def rejects(df: DataFrame, source: str = "source", raw: str = "raw") -> DataFrame:
    """The events that normalize() leaves out, with an error."""
    unknown = ~F.coalesce(F.col(source).isin(*NORMALISERS), F.lit(False))
    return df.filter(~valid(df, source, raw)).withColumn("error", F.when(unknown, "unknown source").otherwise("not a JSON object"))
