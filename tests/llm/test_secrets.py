import base64
import hashlib
import json
import random
import re

from wardspan.llm import secrets

# The contract's patterns as they stand, for comparison.
PLAIN = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(PLAIN.values()) for m in re.finditer(pattern, text) if len(m[group]) >= least)


def own(text):
    return [(s["kind"], s["form"], text[s["start"] : s["end"]]) for s in secrets.spans_of(text) if s["kind"] not in secrets.BASE]


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k)
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1))


RNG = random.Random(13)
RSA = tlv(0x30, number(0), *[number(RNG.getrandbits(b) | 1 << b - 1) for b in (1024, 17, 1023, 512, 512, 511, 510, 509)])
RSA_ID = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5))
PKCS8 = tlv(0x30, number(0), RSA_ID, tlv(4, RSA))
ED = tlv(0x30, number(0), tlv(0x30, tlv(6, bytes.fromhex("2b6570"))), tlv(4, tlv(4, RNG.randbytes(32))))
EC = tlv(0x30, number(1), tlv(4, RNG.randbytes(32)), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))), tlv(0xA1, tlv(3, b"\0" + RNG.randbytes(65))))
ENCRYPTED = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30, tlv(4, b"saltsalt"))), tlv(4, RNG.randbytes(64)))
PUBLIC = tlv(0x30, RSA_ID, tlv(3, b"\0" + tlv(0x30, number(RNG.getrandbits(1024)), number(65537))))


def field(b):
    return len(b).to_bytes(4) + b


def openssh(check=b"1234"):
    inner = b"1234" + check + field(b"ssh-ed25519") + field(RNG.randbytes(32)) + field(RNG.randbytes(64)) + field(b"me") + b"\1\2"
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(field(b"ssh-ed25519") + field(RNG.randbytes(32))) + field(inner)


def b64(data):
    return base64.b64encode(data).decode()


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def pem(label, data, end="\n", close=None):
    body = b64(data)
    return f"-----BEGIN {label}-----{end}{end.join(body[i : i + 64] for i in range(0, len(body), 64))}{end}-----END {close or label}-----"


def token(alg="HS256", n=32, body=None):
    return ".".join([url64(json.dumps({"alg": alg}).encode()), url64(json.dumps(body or {"sub": "x"}).encode()), url64(RNG.randbytes(n))])


def test_base_spans_are_the_patterns():
    for i in range(6000):
        words = RNG.choice([["password", "PASSWD", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "=x1/", "é", "ſecret", "toKen"], ["AKIA", "AK", "IA", "Z9", "B" * 17, " "], ["0a", "f" * 9, "9b1", "g", "A"]])
        text = "".join(RNG.choice(words) for _ in range(RNG.randrange(14)))
        assert [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in secrets.spans_of(text) if s["kind"] in secrets.BASE] == plain(text), repr(text)


def test_keys_between_marks():
    for label, data, form in (
        ("RSA PRIVATE KEY", RSA, "pkcs1"), ("PRIVATE KEY", PKCS8, "pkcs8"), ("PRIVATE KEY", ED, "pkcs8"), ("EC PRIVATE KEY", EC, "sec1"), ("ENCRYPTED PRIVATE KEY", ENCRYPTED, "encrypted"),
        ("OPENSSH PRIVATE KEY", openssh(), "openssh"),
    ):
        for end in ("\n", "\r\n", "\\n", " "):
            assert own(f"x {pem(label, data, end)} y") == [("key", form, pem(label, data, end))], (label, end)
        bad = [x for x in own(pem(label, data[:-1])) + own(pem(label, data + b"\0")) + own(pem(label, data, close="KEY")) if x[0] == "key" and x[2].startswith("---")]
        assert bad == []
    assert own(pem("PUBLIC KEY", PUBLIC)) == [] and own(pem("OPENSSH PRIVATE KEY", openssh(b"4321"))) == []
    legacy = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + b64(bytes(64)) + "\n-----END RSA PRIVATE KEY-----"
    assert own(legacy) == [("key", "legacy", legacy)]


def test_keys_without_marks():
    for data in (RSA, PKCS8, ED, EC, openssh()):
        for run in (b64(data), b64(data).rstrip("="), url64(data), data.hex(), data.hex().upper()):
            assert [x[::2] for x in own(f"key {run},")] == [("key", run)]
        assert own(b64(data[:-3])) == [] and own(b64(data + bytes(3))) == []
    assert own(b64(PUBLIC)) == [] and own(b64(RNG.randbytes(300))) == []
    wrong = bytearray(PKCS8)
    wrong[len(PKCS8) - len(RSA) + 3] += 1  # a nested length
    assert own(b64(bytes(wrong))) == []


def test_signed_tokens():
    good = token()
    other = token("RS256", 256)
    assert own(f"jwt={good}; {other}") == [("signed", "HS256", good), ("signed", "RS256", other)]
    assert [x[1] for x in own(f"a.b.{good}.c {token('none', 0)} {token('ES256', 64)}")] == ["HS256", "none", "ES256"]
    for bad in (token("HS256", 31), token("XX1", 32), token("RS256", 32), good.replace(".", "", 1), "a.b.c", "e.e.e", token("none", 4)):
        assert not [x for x in own(bad) if x[0] == "signed"], bad


def test_encoded_texts_and_logins():
    inner = "password = hunter2hunter2"
    once, twice = b64(inner.encode()), b64(b64(inner.encode()).encode())
    assert own(f"x {once} y") == [("encoded", "assign", once)] and own(twice) == [("encoded", "encoded", twice)] and own(inner.encode().hex())[0][:2] == ("encoded", "assign")
    assert own("Authorization: Basic dXNlcjpwYXNz") == [("login", "basic", "dXNlcjpwYXNz")] and own("Basic training was hard") == []
    deep = inner
    for _ in range(6):
        deep = b64(deep.encode())
    assert own(deep) == [] and own(b64(b"the quick brown fox jumps over")) == []


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "ab" * 200_000, "a." * 200_000, "eyJ." * 100_000, "AKIA" * 100_000, "token" * 80_000, "token" + " " * 400_000, "-----BEGIN RSA PRIVATE KEY-----" * 20_000, "A" * 19 + " " + "A/" * 200_000, "f" * 23 + "g" + "0f" * 200_000, "MII" * 130_000):
        secrets.spans_of(text)


def test_masking_and_rows(spark):
    assert secrets.masked(f"x token=abcdef12 {token()}") == "x <ASSIGN> <SIGNED>" and secrets.masked("") == ""
    df = spark.createDataFrame([(1, "é AKIA" + "A" * 16, 5), (2, None, 5), (2, "", 5), (None, "x", 6)], "doc_id long, text string, spans int")
    assert sorted(((r["doc_id"] or 0), len(r["spans"])) for r in secrets.find_secrets(df).collect()) == [(0, 0), (1, 1), (2, 0), (2, 0)]
    assert secrets.find_secrets(df.limit(0)).count() == 0
    assert [r["t"] for r in df.select(secrets.mask_secrets("text").alias("t")).collect()] == ["é <ACCESS>", None, "", "x"]


def test_query(spark):
    small = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = secrets.op13_secrets(spark, small).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 0
    for r in rows:
        spans = [(list(PLAIN)[k], a, b) for a, k, b in plain(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r["spans"].split(","))
