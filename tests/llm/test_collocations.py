import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from wardspan.llm import collocations as C


def plain(rows, words=5, least=100, top=2000, replaces=100):
    """The contract, word by word."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, words + 1) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    gone = {(k[0], *k[i : i + m]) for k, a in candidates.items() for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1) if 100 * a >= replaces * f[(k[0], *k[i : i + m])]}
    out = []
    for k, a in candidates.items():
        if k not in gone:
            cuts = [(1000 * a * n[k[0]] // (f[k[: i + 1]] * f[k[0], *k[i + 1 :]]), i, f[k[: i + 1]], f[k[0], *k[i + 1 :]]) for i in range(1, len(k) - 1)]
            score, _, left, right = min(cuts)
            out.append((k[0], -score, -a, " ".join(k[1:]).encode(), left, right))
    told = []
    for lang, found in groupby(sorted(out), key=lambda x: x[0]):
        told += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (_, s, a, p, left, right) in enumerate(list(found)[:top])]
    return told


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def found(df, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(df, **how).collect())


def made(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "New", "york", "é", "É", "ſ", "x y", "\x00", "the", " "]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", " ! ", ";"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary[: rng.randrange(3, 13)]) + rng.choice(marks) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None, ""]), rng.choice([text, text, text + " one two three four five six " * rng.randrange(4), None, ""])))
    return rows


SCHEMA = "lang string, text string"


def test_same_as_word_by_word(spark):
    rows = made(1)
    df = spark.createDataFrame([(t, 1, k, 2) for k, t in rows], "text string, phrase int, lang string, score int").repartition(5)
    for how in ({"least": 5, "top": 40}, {"least": 2, "words": 3, "top": 10**6, "replaces": 60}, {"least": 100}):
        assert found(df, **how) == plain(rows, **how), how


def test_blocks_ranges_and_dictionaries(spark, monkeypatch):
    """Small blocks and ranges, words cut off long texts, and dictionaries that come by a join."""
    rows = made(2, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, least=3, top=10**6)
    assert want
    for name, value in (("PLACES", 50), ("STRETCH", 7), ("COUNTED", 5), ("SAMPLE", 50)):
        monkeypatch.setattr(C, name, value)
    assert found(df, least=3, top=10**6) == want
    monkeypatch.setattr(C, "SHIPPED", 3)
    monkeypatch.setattr(C, "BLOCK_BYTES", 2000)
    assert found(df, least=3, top=10**6) == want
    monkeypatch.setattr(C, "digits_for", lambda n: 2)
    assert found(df, least=3, top=10**6) == want


def test_rows(spark):
    df = spark.createDataFrame(made(3), SCHEMA)
    assert found(df.limit(0)) == [] and found(spark.createDataFrame([(None, None), ("en", ""), ("en", "a b. c")], SCHEMA)) == []
    same = spark.createDataFrame([("en", "p q r")] * 100 + [(None, "p q r,s")] * 120, SCHEMA)
    assert found(same) == [("en", 1, "p q r", 100, 100, 100, 300, 3000), ("und", 1, "p q r", 120, 120, 120, 480, 4000)]
    long = [("en", "u v " * 300_000), ("en", "w" * 3_000_000)]
    assert found(spark.createDataFrame(long, SCHEMA)) == plain(long)


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts as of a huge table, put in place of the real ones."""
    big = 3 * 10**13
    real = C.word_counts
    monkeypatch.setattr(C, "word_counts", lambda texts: real(texts).selectExpr("lang", "word", f"IF(word = '', {big}L, c) AS c"))
    monkeypatch.setattr(C, "RANGE_KEYS", 10**13)
    rows = spark.createDataFrame([("en", "p q")] * 1000, SCHEMA)
    monkeypatch.setattr(C, "SAMPLED", 10**14)
    assert found(rows) == [("en", 1, "p q", 1000, 1000, 1000, big, big)]


def test_pieces_of_the_sort():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint16)
    counts = rng.integers(1, 9, 500)
    got, n = C.summed(keys, counts)
    want = Counter()
    for k, c in zip(map(tuple, keys.tolist()), counts.tolist()):
        want[k] += c
    assert list(map(tuple, got.tolist())) == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    assert C.changes(got)[0] == 0 and (np.sort(C.as_bytes(got)) == C.as_bytes(got)).all()
    back = C.unpacked(C.packed(got, n), len(got), 4)
    assert (back[0] == got).all() and (back[1] == n).all()
    big = np.array([[65535, 0], [65535, 65535]], np.uint16), np.array([1, 2**32 - 1])
    assert [x.tolist() for x in C.unpacked(C.packed(*big), 2, 2)] == [x.tolist() for x in big]
    assert C.digits_for(0) == C.digits_for(65535) == 1 and C.digits_for(65536) == 2
    wide = C.keys_of(np.array([70000, 5, 0, 9]), 4, 2, 3)
    assert wide.tolist() == [[1, 4464, 0, 5, 0, 0]]


@pytest.mark.parametrize("least", [100, 20])
def test_query_tables(spark, least):
    path = "/root/testdata/sf0.01"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    df = C.op11_collocations(spark, path) if least == 100 else C.collocations(C.documents(spark, path), least=least)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in df.collect()) == plain(rows, least=least)
