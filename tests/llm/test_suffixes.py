import random
import re
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from wardspan.llm import suffixes as S

WORD = re.compile(r"[^ \t-\r]+")


def repeated(docs, n):
    """Word places of each text that lie in n words another text has too."""
    words, own, out = {i: WORD.findall(t or "") for i, t in docs}, defaultdict(set), defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            own[tuple(w[j : j + n])].add(i)
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            if len(own[tuple(w[j : j + n])]) > 1:
                out[i].update(range(j, j + n))
    return out


def places(rows, docs):
    texts, out = dict(docs), defaultdict(set)
    for r in rows:
        spans = [m.span() for m in WORD.finditer(texts[r["doc_id"]])]
        a, b = [s for s, _ in spans].index(r["start"]), [e for _, e in spans].index(r["end"])
        out[r["doc_id"]].update(range(a, b + 1))
    return out


def test_passages(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared, docs = [text(n) for n in (49, 50, 51, 80, 300)], []
    for i in range(60):
        w = text(rng.randrange(0, 200))
        for p in rng.sample(shared, rng.randrange(3)):
            w += p + text(rng.randrange(5))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    docs += [(100, " ".join(["la"] * 400)), (101, "é " + " ".join(["la"] * 300)), (102, None), (103, ""), (104, " ".join(text(60) * 3))]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, gram int")
    got = places(S.repeated_passages(df).collect(), docs)
    expected = repeated(docs, 50)
    assert set(got) == set(expected)
    for i in expected:
        assert got[i] == expected[i], i


def test_pieces():
    h = np.arange(100, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)
    for n in (1, 5, 7, 25):
        joined = S.gram_hashes(np.concatenate([h[10:60], h[40:45]]), n)
        assert (joined[: 50 - n + 1] == S.gram_hashes(h, n)[10 : 60 - n + 1]).all()
    r = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    chosen = set(S.minimisers(r, 26).tolist())
    assert all(any(i + j in chosen for j in range(26)) for i in range(275))


def test_empty(spark):
    df = spark.createDataFrame([(None, "a " * 100), (1, "a " * 100)], "doc_id long, text string")
    assert S.repeated_passages(df).count() == 0 and S.repeated_passages(df.limit(0)).count() == 0


def test_passage_many_times_in_one_document(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(100)]
    docs = [(1, " ".join(shared * 20)), (2, " ".join(shared)), (3, " ".join(shared * 7))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got, expected = places(S.repeated_passages(df.filter("doc_id < 3")).collect(), docs[:2]), repeated(docs[:2], 50)
    assert got == expected and len(got[1]) == 2000
    assert places(S.repeated_passages(df).collect(), docs) == repeated(docs, 50)


def test_passage_across_the_gram_between_fillers(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    while True:
        p, left, right = text(50), text(60), text(60)
        h, _ = S.word_hashes([" ".join(left + p + right)])
        if [a - 60 for a in S.minimisers(S.gram_hashes(h, 25), 26) if 60 <= a <= 85] == [12]:
            break
    l, g, r = p[:12], p[12:37], p[37:]
    docs = [(0, left + p + right)]
    for i in range(1, 400, 2):
        docs += [(i, text(60) + g + r + text(60)), (i + 1, text(60) + l + g + text(60))]
    docs.append((1000, text(60) + p + text(60)))
    docs = [(i, " ".join(w)) for i, w in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert places(S.repeated_passages(df).collect(), docs) == repeated(docs, 50) == {0: set(range(60, 110)), 1000: set(range(60, 110))}


def test_near_copies_with_edits(spark):
    rng = random.Random(6)
    base, docs = [f"w{rng.randrange(10**9)}" for _ in range(600)], []
    for i in range(300):
        w = list(base)
        for j in range(rng.randrange(30), 600, 30):
            w[min(599, j + rng.randrange(25))] = f"e{i}_{j}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert places(S.repeated_passages(df).collect(), docs) == repeated(docs, 50)


def test_sf_documents_all_places(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert places(S.op8_suffix_dedup(spark, small).collect(), docs) == repeated(docs, 50)


def test_decoys_on_both_sides(spark):
    """Pairs share 50 words; others share the seed and 24 words on one side of it, 49 words, and stand between the pair in any order."""
    rng, docs, number = random.Random(11), [], 0
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(30):
        while True:
            left, g, right = text(13), text(25), text(12)
            body = text(60) + left + g + right + text(60)
            h, _ = S.word_hashes([" ".join(body)])
            if [a for a in S.minimisers(S.gram_hashes(h, 25), 26) if 60 <= a <= 85] == [73]:
                break
        passage, far = left + g + right, text(24)
        docs += [(number, text(60) + passage + text(60)), (number + 1, text(60) + passage + text(60))]
        for k in range(6):
            docs.append((number + 2 + 2 * k, text(60) + (far + left)[-24:] + g + text(60)))
            docs.append((number + 3 + 2 * k, text(60) + g + (right + far)[:24] + text(60)))
        number += 14
    rng.shuffle(docs)
    docs = [(i, " ".join(w)) for i, w in docs]
    got = places(S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    expected = repeated(docs, 50)
    assert got == expected and {i for i in expected if i % 14 < 2} == {14 * k + j for k in range(30) for j in range(2)}


def test_rows_of_one_id_and_a_very_long_text(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, q, long = text(60), text(70), text(200_000)
    rows = [(1, p + text(5)), (1, text(5) + q), (2, text(9) + p), (3, q + text(9)), (4, text(70)), (4, long), (5, long[150_000:150_055]), (6, text(80))]
    rows += [rows[-1]]
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in rows], "doc_id long, text string, id int").withColumns({"doc": F.lit("x"), "key": F.lit(1), "around": F.lit(2)})
    got = sorted((r["doc_id"], r["n_words"], r["partner_id"]) for r in S.repeated_passages(df).collect())
    assert got == [(1, 60, 2), (1, 70, 3), (2, 60, 1), (3, 70, 1), (4, 55, 5), (5, 55, 4)]
