"""Operator 13: secrets in texts, confirmed by their structure.

Three plain patterns (assignments, access ids, hex runs) are the base. Beside
them, runs of base64 or hex are decoded, and only what parses to the end is
reported: DER and OpenSSH private keys, whose nested lengths have to fill their
parents, signed tokens, whose header names an algorithm that the signature's
length fits, logins, and encoded texts that hold a secret themselves. All
patterns take time linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.llm.base import documents, map_texts

# Kinds in their order, the base ones first, and the least length of a base span (of an assignment's value).
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "signed", "login", "encoded")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Encoded texts are opened so many times, one inside the other.
DEPTH = 3
#: Runs of base64 or hex from so many characters on are decoded.
RUN = 20

# Bytes of a signature by algorithm; those of the RSA family have the key's length, 128 bytes at least.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_FAMILY = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
OPENSSH = b"openssh-key-v1\0"
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_RUNS = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d}[A-Za-z0-9+/_-]*+={0,2}" % RUN)
_BASIC = re.compile(r"basic ([A-Za-z0-9+/]{4,}+={0,2})", re.IGNORECASE | re.ASCII)
_PURE_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
_MARKS = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,64})-----")
_LOGIN = re.compile(r"[!-9;-~]+:[ -~]+\Z")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("form", T.StringType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("form", pa.string())]))


def base_spans(text: str):
    """Spans (kind, start, end, form) of the plain patterns; form is the pattern's own."""
    for m in _ASSIGN.finditer(text):
        if len(m[1]) >= LEAST["assign"]:
            yield "assign", *m.span(), "value"
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= LEAST["access"]:
                yield "access", *m.span(), "id"
    at = 0
    while m := _LONG_HEX.search(text, at):  # the first place with so many hex digits is where a long run begins
        at = _HEX.match(text, m.start()).end()
        yield "hex", m.start(), at, "digits"


def unbase64(run: str | bytes) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without its padding; None if it isn't."""
    raw = run.encode() if isinstance(run, str) else run
    raw = raw.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """The DER elements (tag, start, end of their content) that fill a stretch exactly; None if they don't."""
    out, end = [], len(data) if end is None else end
    while start < end:
        if end - start < 2 or data[start] & 0x1F == 0x1F:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 0 < n <= 8 or start + n > end:
                return None
            length, start = int.from_bytes(data[start : start + n]), start + n
            if length < 0x80:  # DER takes the shortest form
                return None
        if start + length > end:
            return None
        out.append((tag, start, start + length))
        start += length
    return out


def nested(data: bytes, start: int, end: int, depth: int = 16) -> bool:
    """Whether constructed elements are filled by theirs, all the way down."""
    found = elements(data, start, end)
    return found is not None and depth > 0 and all(nested(data, a, b, depth - 1) for tag, a, b in found if tag & 0x20)


def der_key(data: bytes) -> str | None:
    """Name of the private key's form that a DER document has: pkcs1, dsa, sec1, pkcs8 or encrypted."""
    if not data.startswith(b"\x30"):
        return None
    top = elements(data)
    if not top or len(top) != 1 or not nested(data, 0, len(data)):
        return None
    inner = elements(data, *top[0][1:])
    tags = [tag for tag, _, _ in inner]
    value = lambda k: data[inner[k][1] : inner[k][2]]
    small = value(0) if tags[:1] == [INTEGER] else None
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER} and small in (b"\0", b"\1") and inner[1][2] - inner[1][1] >= 32:
        return "pkcs1"
    if len(tags) == 6 and set(tags) == {INTEGER} and small == b"\0":
        return "dsa"
    if tags[:2] == [INTEGER, OCTETS] and small == b"\1" and 16 <= len(value(1)) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1"
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and small in (b"\0", b"\1"):
        kind = elements(data, *inner[1][1:])
        key = value(2)
        whole = key[:1] not in (b"\x30", b"\x04") or nested(key, 0, len(key))
        return "pkcs8" if kind and kind[0][0] == OID and key and whole else None
    if tags == [SEQUENCE, OCTETS]:
        kind = elements(data, *inner[0][1:])
        return "encrypted" if kind and kind[0][0] == OID and len(value(1)) and len(value(1)) % 8 == 0 else None
    return None


def openssh_key(data: bytes) -> str | None:
    """openssh if the length-prefixed fields of a version 1 file fill it and, unencrypted, its two check numbers agree."""
    if not data.startswith(OPENSSH):
        return None
    at, end = len(OPENSSH), len(data)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > end or at + 4 + (n := int.from_bytes(data[at : at + 4])) > end:
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if None in (cipher, kdf, options) or at + 4 > end:
        return None
    n, at = int.from_bytes(data[at : at + 4]), at + 4
    if not 0 < n <= (end - at) // 4 or any(field() is None for _ in range(n)):
        return None
    private = field()
    if private is None or at != end or len(private) < 8:
        return None
    return "openssh" if cipher != b"none" or private[:4] == private[4:8] else None


def key_form(data: bytes | None) -> str | None:
    return None if not data else der_key(data) or openssh_key(data)


def pem_form(label: str, body: str) -> str | None:
    """Form of a private key between two marks; of one under its own cipher, legacy."""
    if not label.endswith("PRIVATE KEY"):
        return None
    lines = body.replace("\\r", "").replace("\\n", "\n").split("\n")
    heads = [x for x in lines if ":" in x]
    data = unbase64("".join("".join(x.split()) for x in lines if ":" not in x).encode("utf-8", "replace"))
    if any("DEK-Info" in x for x in heads):
        return "legacy" if data and len(data) % 8 == 0 else None
    return key_form(data)


def pem_spans(text: str):
    """Private keys between BEGIN and the very next mark, if that is the END of the same label."""
    begin = None
    for m in _MARKS.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2] and (form := pem_form(m[2], text[begin.end() : m.start()])):
            yield "key", begin.start(), m.end(), form
        begin = m if m[1] == "BEGIN" else None


def json_object(part: str) -> dict | None:
    data = unbase64(part)
    if not data:
        return None
    try:
        told = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return told if isinstance(told, dict) else None


def algorithm(head: str, body: str, signature: str) -> str | None:
    """The algorithm of a signed token, if its signature has a fitting length."""
    if not head.startswith("e") or not (told := json_object(head)):
        return None
    name, signed = told.get("alg"), unbase64(signature) or b""
    if name == "none":
        fits = not signature
    elif name in RSA_FAMILY:
        fits = len(signed) >= 128
    else:
        fits = isinstance(name, str) and len(signed) == SIGNATURE.get(name, -1)
    return name if fits and json_object(body) is not None else None


def signed_spans(text: str):
    """Signed tokens: three parts in a row of a dotted run."""
    for m in _DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            name = algorithm(*parts[i : i + 3])
            step = 3 if name else 1
            length = sum(map(len, parts[i : i + step])) + step
            if name:
                yield "signed", at, at + length - 1, name
            at, i = at + length, i + step


def login_spans(text: str):
    """Base64 after the word basic that stands for a name, a colon and a password."""
    for m in _BASIC.finditer(text):
        if (data := unbase64(m[1])) and (told := decoded_text(data)) and _LOGIN.match(told):
            yield "login", *m.span(1), "basic"


def own_spans(text: str, depth: int = DEPTH):
    """Spans that decoding confirms; keys between marks, signed tokens and logins aren't opened again."""
    whole = [*(pem_spans(text) if "-----BEGIN " in text else ()), *(signed_spans(text) if "." in text else ()), *login_spans(text)]
    yield from whole
    whole.sort(key=lambda s: s[1])
    k = 0
    for m in _RUNS.finditer(text):
        a, b = m.span()
        while k < len(whole) and whole[k][2] <= a:
            k += 1
        if k < len(whole) and whole[k][1] < b:
            continue
        run = m[0].rstrip("=")
        tries = [bytes.fromhex(run)] if len(run) % 2 == 0 and _PURE_HEX.match(run) else []
        tries += [data] if (data := unbase64(run)) else []
        for data in tries:
            if form := key_form(data):
                yield "key", a, b, form
                break
            told = decoded_text(data) if depth else None
            inner = told and next((x[0] for x in (*base_spans(told), *own_spans(told, depth - 1)) if x[0] != "hex"), None)
            if inner:
                yield "encoded", a, b, inner
                break


def decoded_text(data: bytes) -> str | None:
    """Decoded bytes as text if they are printable ASCII with blanks and line ends."""
    return data.decode() if data.isascii() and (told := data.translate(None, b"\t\r\n").decode()) and told.isprintable() else None


def spans_of(text: str) -> list[dict]:
    """All spans by start, then kind."""
    found = sorted((a, KINDS.index(kind), b, form) for kind, a, b, form in (*base_spans(text), *own_spans(text)))
    return [{"kind": KINDS[k], "start": a, "end": b, "form": form} for a, k, b, form in found]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end, form) in code points.

    form is a key's format, a token's algorithm, or the kind of secret inside an
    encoded text. Null and empty texts have no spans; repeated rows stay; an
    empty table gives none; other columns aren't read.
    """
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
def mask_secrets(texts: pa.Array) -> pa.Array:
    """A column of masked texts; null stays null."""
    return pa.array([None if t is None else masked(t) for t in texts.to_pylist()], pa.string())


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
