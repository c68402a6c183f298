"""Operator 3: personal data in texts.

Regular expressions propose spans, checksums (Luhn for cards, mod-97 for bank
accounts) confirm them, and whole words near either side move a span's score. All patterns take
time linear in the text, whatever it holds.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.llm.base import documents, map_texts

# Kinds in their order, the base ones first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score of a confirmed span by itself.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.3}
#: Whole words that raise or lower the score of a kind among the CONTEXT_WORDS nearest before the span or after it, up to CONTEXT characters away.
CONTEXT_WORDS = 6
CONTEXT = 60
RAISE = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
LOWER = {"ip": ("version", "release", "section", "chapter"), "card": ("order", "serial", "isbn"), "phone": ("serial", "isbn")}
STEP = 0.3
#: The method's own spans need this score; base spans stay whatever their score.
THRESHOLD = 0.5
# Lengths of bank account numbers by country.
IBAN_LENGTH = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

_WORDS = re.compile(r"[^\W\d_]+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    """Leftmost matches: each @ with a domain takes the run of name characters before it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        name = text[free:at]
        n = len(name) - len(name.rstrip(_LOCAL))
        free = at + 1
        if n and (m := _DOMAIN.match(text, at)):
            yield at - n, m.end()
            free = m.end()
        at = text.find("@", free)


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def proposals(text: str):
    """Confirmed spans (kind, start, end), in no order."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(byte_sized, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    at = 0
    while m := _IBAN.search(text, at):  # a match can reach past its account into the next one
        at = m.start() + 1
        need, end, account = IBAN_LENGTH.get(m[0][:2], 0), m.start(), ""
        for c in m[0]:
            if len(account) == need:
                break
            account, end = account + c.strip(), end + 1
        if need and len(account) == need and not text[end : end + 1].isalnum() and mod97(account):
            yield "iban", m.start(), end
            at = end
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


def nearby(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Lower-cased whole words before and after a span, in their order; a word that the reach cuts doesn't count."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    before, after = _WORDS.findall(text[lo:start].lower()), _WORDS.findall(text[end:hi].lower())
    if before and lo and text[lo - 1].isalpha() and text[lo].isalpha():
        before = before[1:]
    if after and hi < len(text) and text[hi].isalpha() and text[hi - 1].isalpha():
        after = after[:-1]
    return before[-CONTEXT_WORDS:], after[:CONTEXT_WORDS]


def scored(text: str, kind: str, start: int, end: int) -> float:
    sides = nearby(text, start, end)
    known = [f" {' '.join(words)} " for words in sides]
    near = lambda names: any(f" {n} " in side for n in names for side in known)
    score = SCORES[kind] + STEP * near(RAISE[kind]) - STEP * near(LOWER.get(kind, ()))
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str) -> list[dict]:
    """All spans by start, then kind; the method's own only from THRESHOLD on."""
    found = [(a, KINDS.index(kind), b, scored(text, kind, a, b)) for kind, a, b in proposals(text)]
    return [{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(found) if k < len(BASE) or s >= THRESHOLD]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end, score) in code points. Null and empty texts have no spans; repeated rows stay; an empty table gives none."""
    return map_texts(df, lambda: lambda texts: {"spans": pa.array(map(spans_of, texts), _ARROW)}, f"spans {SPANS.simpleString()}", id_col, text_col)


def masked(text: str) -> str:
    """A text with <KIND> in place of each span; spans that overlap become one."""
    out, done = [], 0
    for s in spans_of(text):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


@F.arrow_udf(T.StringType())
def mask_pii(texts: pa.Array) -> pa.Array:
    """A column of masked texts; null stays null."""
    return pa.array([None if t is None else masked(t) for t in texts.to_pylist()], pa.string())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("max_score"),
    )
