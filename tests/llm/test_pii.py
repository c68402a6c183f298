import hashlib
import random
import re

from wardspan.llm import pii

# The contract's patterns as they stand, for comparison.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    d = re.sub("[^0-9]", "", s)
    if kind == "phone":
        return 10 <= len(d) <= 15
    return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text) if holds(kind, m[0]))


def test_base_spans_are_the_patterns(spark):
    rng = random.Random(2)
    for i in range(6000):
        letters = rng.choice(["ab@.-+ 1", "01.+ -()5", "0123456789 -", "a@b.c-"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        if i % 3 == 0:
            text = f"{rng.randrange(300)}.{rng.randrange(300)}.1.{rng.randrange(99)}{text} 4524132264652876"
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in pii.spans_of(text) if s["kind"] in pii.BASE] == plain(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "@a" * 200_000, "+1 " + "." * 400_000):
        pii.spans_of(text)


def test_own_spans_need_checksum_or_context():
    kinds = lambda t: [s["kind"] for s in pii.spans_of(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"] and kinds("pay to DE89 3704 0044 0532 0130 01 now") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []


def test_masking():
    assert pii.masked("mail a@b.cd or +1 (988) 555-2485.") == "mail <EMAIL> or <PHONE>."
    assert pii.masked("") == "" and pii.masked("clean text") == "clean text"


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = pii.op3_pii(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = [(list(PLAIN)[k], a, b) for a, k, b in plain(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_rows(spark):
    df = spark.createDataFrame([(1, "é a@b.cd", 5), (2, None, 5), (2, "", 5)], "doc_id long, text string, spans int")
    rows = {(r["doc_id"], len(r["spans"])) for r in pii.find_pii(df).collect()}
    assert rows == {(1, 1), (2, 0)} and pii.find_pii(df.limit(0)).count() == 0
    shown = df.select(pii.mask_pii("text").alias("t")).collect()
    assert [r["t"] for r in shown] == ["é <EMAIL>", None, ""]


def test_accounts_after_other_codes():
    ibans = lambda t: [t[s["start"] : s["end"]] for s in pii.spans_of(t) if s["kind"] == "iban"]
    de, gb = "DE89370400440532013000", "GB82WEST12345698765432"
    assert ibans(f"{de} {gb}") == [de, gb] and ibans(f"AB12 {gb} {de}") == [gb, de] and ibans(f"X{de}") == []
    assert pii.masked(f"{de} {gb}") == "<IBAN> <IBAN>"
    pii.spans_of("AB12 " * 100_000)


def test_context_is_whole_words_on_both_sides():
    score = lambda t: pii.spans_of(t)[0]["score"]
    number = "+1 (988) 555-2485"
    for t in (f"hotel {number}", f"postcard {number}", f"{number} hotels", number, f"a phone{'x' * 60} {number}"):
        assert score(t) == pii.SCORES["phone"], t
    for n in range(70):  # wherever the reach cuts the word before
        assert score(f"hotel {'x' * n} {number}") == score(f"{number} {'x' * n} telling") == pii.SCORES["phone"]
    assert score(f"tel: {number}") == score(f"{number} (mobile)") == 1.0
    assert score(f"serial {number}") == score(f"{number} is a serial") == 0.4 and score(f"phone of the serial {number}") == pii.SCORES["phone"]
    assert [s["kind"] for s in pii.spans_of("123-45-6789 is a social security number")] == ["ssn"]
    assert pii.spans_of("asocial securityx 123-45-6789") == []
    assert score(f"one phone and seven other words stand in between {number}") == pii.SCORES["phone"]
