import random
import re

import numpy as np

from pyspark.sql import functions as F

from wardspan.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made(n, seed):
    """Families of copies with more and fewer edits, so that links form chains and pivots miss some."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 120]))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(12) if len(w) > 10 else rng.randrange(2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w).upper() if i % 5 == 0 else "\t".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, None)]


def test_groups_are_those_of_all_pairs(spark):
    for k, percent, seed in ((3, 85, 1), (5, 80, 2)):
        docs = made(160, seed)
        df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, comp int")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(df, k, percent).collect()}
        assert got == plain(docs, k, percent)


def test_large_components_have_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    for k, percent, seed in ((3, 85, 3), (5, 80, 4)):
        docs = made(160, seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(df, k, percent).collect()}
        assert got == plain(docs, k, percent)


def test_blocks_without_pivots(spark, monkeypatch):
    """Blocks alone find the links between members of a bucket, whatever the components so far."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    sets = []
    for i in range(90):
        s = base.copy()
        at = rng.choice(100, int(rng.integers(1, 14)), replace=False)
        s[at] = rng.integers(0, 1 << 62, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    _, low = minhash.signatures(sets, 21, 6)
    comp = [0 if i < 50 else i for i in range(90)]
    frame = spark.createDataFrame
    shared = frame([(key, i) for key in (1, 2) for i in range(90)], "key long, id long")
    labels = frame([(i, c) for i, c in enumerate(comp) if i < 50], "id long, comp long")
    signed = frame([(i, x.tolist()) for i, x in enumerate(low)], "id long, low array<long>")
    held = frame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "id long, shingles array<long>")
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))

    def joined(pairs):
        top = list(range(90))
        for a, b in pairs:
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    want = joined([(0, i) for i in range(50)] + [(i, j) for i in range(90) for j in range(i) if linked(sets[i], sets[j])])
    for block in (8, 256):
        monkeypatch.setattr(minhash, "BLOCK", block)
        found = [(r["a"], r["b"]) for r in minhash.block_links(shared, labels, signed, held, 126, 0.85, 0).collect()]
        assert found and joined([(0, i) for i in range(50)] + found) == want


def test_block_with_many_members():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(60)]
    for i in range(1, 60, 3):
        sets[i] = np.unique(np.concatenate([sets[i - 1][2:], rng.integers(300, 400, 2).astype(np.uint64)]))
    low = np.zeros((60, 8), np.uint64)
    found = minhash.joining(low, sets, list(range(60)), np.zeros(60, int), 125, 0.85, 0)
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert {tuple(sorted(p)) for p in found} == {(i, j) for i in range(60) for j in range(i + 1, 60) if linked(sets[i], sets[j])}


def test_bands_miss_little_at_the_threshold():
    for t in (0.8, 0.85):
        bands, rows = minhash.bands_for(t)
        assert bands * rows <= minhash.PERMUTATIONS and (1 - t**rows) ** bands <= minhash.MISS


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(df, 3, 85).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_groups(df.limit(0), 3, 85).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rng = random.Random(7)
    ids, calls, cut = list(range(10_000)), [], minhash.cut
    rng.shuffle(ids)
    monkeypatch.setattr(minhash, "cut", lambda df: calls.append(1) or cut(df))
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (20_000, 20_001), (5, 5)], "a long, b long")
    got = {r["id"]: r["comp"] for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in ids} | {20_000: 20_000, 20_001: 20_000}
    assert len(calls) - 2 < 25


def test_buckets_with_equal_sums_both_stay(spark):
    """Two buckets of other members whose 40-bit hash sums agree, found by a search, are not taken for one."""
    pairs = spark.range(1 << 22).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))
    both = F.xxhash64("a") % (1 << 40) + F.xxhash64("b") % (1 << 40)
    twice = pairs.groupBy(both.alias("h")).agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").first()
    assert twice, "no two sums agree"
    members = [(1, twice["x"]), (1, twice["x"] + 1), (2, twice["y"]), (2, twice["y"] + 1), (3, twice["y"] + 1), (3, twice["y"])]
    placed = spark.createDataFrame([(k, i, i) for k, i in members], "key long, id long, comp long")
    assert sorted(r["of"]["key"] for r in minhash.mixed_buckets(placed).collect()) == [1, 2]


def test_ids_with_two_texts(spark):
    """Each text of a repeated id links on its own, and the id's texts are one document."""
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10**9)}" for _ in range(60)]
    rows = []
    for i in range(60):
        for side in range(2):
            w = text()
            rows += [(i, " ".join(w), "x"), (1000 + 2 * i + side, " ".join([*w[:-1], "other"]), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({"doc": F.lit(1), "set1": F.lit("a"), "key": F.lit(0)})
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(df, 3, 85).collect()}
    assert got == {(i, i, True) for i in range(60)} | {(1000 + 2 * i + side, i, False) for i in range(60) for side in range(2)}


def test_very_long_text(spark):
    rng = random.Random(10)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:280_000])), (3, " ".join(w[:150_000])), (4, "la " * 300_000)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
