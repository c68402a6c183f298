import json

import pytest

from wardspan.operators.normalize import normalize, rejects

CASES = [
    ("aws_cloudtrail", {"eventTime": "2024-01-02T03:04:05Z", "userIdentity": {"userName": "alice"}, "eventName": "GetObject", "requestParameters": {"bucketName": "b", "key": "k"}, "sourceIPAddress": "203.0.113.42"}, ("alice", "GetObject", "b", "203.0.113.42")),
    ("aws_cloudtrail", {"userIdentity": {"userName": "", "principalId": "P1"}, "eventName": "X", "requestParameters": {"key": "k"}}, ("P1", "X", '{"key":"k"}', "")),
    ("aws_cloudtrail", {"userIdentity": None, "eventName": None, "requestParameters": {}}, ("", "", "", "")),
    ("azure_ad", {"createdDateTime": "t", "userPrincipalName": "u@x", "appDisplayName": "App", "resourceDisplayName": "R", "ipAddress": "1.2.3.4"}, ("u@x", "App", "R", "1.2.3.4")),
    ("azure_ad", {"InitiatedBy": '{"user": {"userPrincipalName": "i@x"}}', "OperationName": "Op", "TargetResources": [{"displayName": "", "id": "T1"}]}, ("i@x", "Op", "T1", "")),
    ("azure_ad", {"properties": {"userPrincipalName": "p@x", "appDisplayName": "A"}, "callerIpAddress": "9.9.9.9"}, ("p@x", "A", "", "9.9.9.9")),
    ("cloudflare_access", {"action": " Login ", "allowed": False, "user_email": "c@x", "app_domain": "d", "ip_address": "1.1.1.1"}, ("c@x", "login (denied)", "d", "1.1.1.1")),
    ("cloudflare_access", {"user_email": "c@x"}, ("c@x", "access", "", "")),
    ("cert_logon", {"user": "U", "pc": "PC-1", "activity": "Logon"}, ("U", "Logon:Logon", "PC-1", "")),
    ("cert_logon", {"user": "U", "pc": "PC-1", "activity": ""}, ("U", "Logon", "PC-1", "")),
    ("cert_file", {"user": "U", "filename": "f.zip"}, ("U", "File Activity", "f.zip", "")),
    ("cert_device", {"user": "U", "pc": "P", "activity": "Connect"}, ("U", "Device:Connect", "P", "")),
    ("cert_email", {"user": "U", "to": "a@b", "activity": "Send"}, ("U", "Send", "email→a@b", "")),
    ("cert_email", {"user": "U"}, ("U", "Send Email", "email", "")),
    ("cert_http", {"user": "U", "url": "http://x"}, ("U", "HTTP Request", "http://x", "")),
    ("github_events", {"type": "PushEvent", "actor": {"login": "g"}, "repo": {"name": "o/r"}, "payload": {"size": 1}}, ("g", "Code push (1 commit)", "o/r", "")),
    ("github_events", {"type": "PushEvent", "actor": {"display_login": "d"}, "repo": {"name": "o/r"}}, ("d", "Code push (0 commits)", "o/r", "")),
    ("github_events", {"type": "PullRequestEvent", "actor": {"login": "g"}, "payload": {"action": "opened"}}, ("g", "PR opened", "", "")),
    ("github_events", {"type": "ForkEvent", "actor": {"login": "g"}}, ("g", "Repository forked", "", "")),
    ("github_events", {"type": "OtherEvent"}, ("", "OtherEvent", "", "")),
]


@pytest.fixture(scope="module")
def normal(spark):
    rows = [(i, s, json.dumps(e)) for i, (s, e, _) in enumerate(CASES)] + [(90, "nowhere", "{}"), (91, "cert_http", "[1]"), (92, "cert_http", "{broken"), (93, None, None)]
    df = spark.createDataFrame(rows, "i int, source string, raw string")
    return {r["i"]: r for r in normalize(df).collect()}, {r["i"]: r["error"] for r in rejects(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fields(normal, i):
    row = normal[0][i]
    assert (row["user"], row["action"], row["resource"], row["ip_address"]) == CASES[i][2]


def test_metadata_and_rejects(normal):
    good, bad = normal
    assert json.loads(good[0]["metadata"]["userIdentity"]) == {"userName": "alice"}
    assert "cc" not in good[12]["metadata"] and good[12]["metadata"]["to"] == "a@b"
    assert bad == {90: "unknown source", 91: "not a JSON object", 92: "not a JSON object", 93: "unknown source"}


def test_fields_that_nobody_reads_are_not_made(spark):
    from wardspan.operators import normalize

    raw = spark.createDataFrame([("cert_http", "{}")], "source string, raw string")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("variant_get")
    every, one = reads(normalize.normalize(raw)), reads(normalize.normalize(raw).select("ip_address"))
    assert every > 60 and one < every / 8
    assert normalize.normalize(raw).select("source").count() == 1
