"""Word and pattern lists, as conditions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word families of cloud features, between word boundaries, in any case.
IAM = "iam|sts|kms|ssm|secretsmanager|credential|getpolicyversion|listpolicies|listentitiesforpolicy|attachuserrole|detachrole|createrole|deleterole|createuser|deleteuser|createaccesskey|updateaccesskey|createloginprofile|listusers|listroles|microsoft\\.authorization|microsoft\\.aad|passwordprofile|passwordreset|addmember|removemember"
EXFIL = "getobject|listobjects|listbuckets|getbucketacl|downloadobject|readfile|listfiles|listshares|downloadblob|getblob|listblobs|describeinstances|getsecretvalue|getparameter|getparameters|describedbinstances|listfunctions|getfunction|readcontents|listobject|read|download|get|list"
ADMIN = "createuser|deleteuser|creategroup|deletegroup|createpolicy|deletepolicy|attachpolicy|detachpolicy|putrolepolicy|updateassumerolepolicy|createaccesskey|createloginprofile|updateloginprofile|changepassword|enablemfadevice|deactivatemfadevice|addusertopolicy|removeuserfromgroup|addmember|removemember|activatedirectory|createapplication|deleteapplication|runinstances|terminateinstances|startinstances|stopinstances|createbucket|deletebucket|createfunction|deletefunction"
ASSUME = "assumerole|getsessiontoken|getfederationtoken|assumerolewithsaml|assumerolewithwebidentity|impersonation|addmember|oauth"
ERROR = "error|denied|fail|unauthoriz|forbidden|accessdeni|not\\s*found|invalid|except|throttl|limit"
SENSITIVE_WORDS = "iam|secret|kms|admin|root|password|credential|token|key|ssm|backup|prod|production|confidential|sensitive|pii|financial|salary|internal|private|vpn|ssh"
# Patterns of sensitive resources, anywhere, in any case.
SENSITIVE_RESOURCE = "iam|secretsmanager|kms|sts|ssm|s3.*\\b(?:backup|sensitive|pii|financial|prod|production|confidential)\\b|rds|dynamodb|keyvault|microsoft\\.keyvault|microsoft\\.authorization|microsoft\\.aad|passwordprofile|credential|password|secret|token|private.?key|ssh|vpn|admin|root|sudo|shadow|passwd|\\.exe$|usb|removable|wikileaks|jobsite"
# Sites and extensions of the training dialect.
TRAIN_JOB = ["indeed", "monster", "glassdoor", "careerbuilder", "linkedin.com/jobs", "hotjobs"]
TRAIN_CLOUD = ["dropbox", "drive.google", "box.com", "onedrive", "mega.nz", "wikisend", "mediafire"]
TRAIN_SUSPICIOUS = ["wikileaks", "pastebin", *TRAIN_JOB, *TRAIN_CLOUD]
TRAIN_ARCHIVE = ["zip", "rar", "7z", "tar", "gz", "bz2"]
TRAIN_EXE = ["exe", "msi", "bat", "cmd", "ps1", "sh"]
# Of the live dialect.
LIVE_JOB = ["linkedin", "indeed", "glassdoor", "monster", "careerbuilder", "ziprecruiter", "seek", "reed", "totaljobs", "jobstreet"]
LIVE_CLOUD = ["dropbox", "drive.google", "onedrive", "box.com", "mega.nz", "wetransfer", "sharepoint"]
LIVE_SUSPICIOUS = ["pastebin", "pastecode", "ghostbin", "hastebin", "anonfiles", "filebin", "temp.sh"]
LIVE_ARCHIVE = ["zip", "tar", "gz", "7z", "rar", "bz2", "tgz"]


def any_word(text: Column, family: str) -> Column:
    return text.rlike(rf"(?i)\b({family})\b")


def any_of(text: Column, needles: list[str], escape: bool = True) -> Column:
    """Whether a lower-cased text contains one of the needles; unescaped, a dot stands for any character."""
    return F.lower(text).rlike("|".join(re.escape(n) if escape else n for n in needles))


def sensitive_resource(resource: Column) -> Column:
    return F.coalesce(resource, F.lit("")).rlike(f"(?i)({SENSITIVE_RESOURCE})")


def is_error(action: Column) -> Column:
    return any_word(action, ERROR) | F.lower(action).contains("(denied)")


def cloud_flags(action: Column, resource: Column) -> dict[str, Column]:
    """Conditions of the word families on an event."""
    both = F.lower(F.concat_ws(" ", F.lower(F.trim(action)), F.trim(resource)))
    return {
        "sensitive_events": any_word(F.trim(resource), SENSITIVE_WORDS),
        "error_events": is_error(F.lower(F.trim(action))),
        "iam_sts_events": any_word(both, IAM),
        "data_exfil_events": any_word(both, EXFIL),
        "admin_events": any_word(both, ADMIN),
        "assume_role_events": any_word(both, ASSUME),
    }
