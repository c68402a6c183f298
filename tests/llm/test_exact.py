import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from wardspan.llm import exact


def plain(docs):
    groups, out = defaultdict(list), {}
    for i, t in docs:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_groups(spark):
    prefix = "p" * 80
    texts = ["a b", "ab", "a\tb\n", "ba", "", None, "  ", prefix + "x", prefix + "y", prefix + " x", "é e", "ée", "\x0b\x0ca b"]
    docs = list(enumerate(texts * 2))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, prefix_ int")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_groups(df).collect()}
    assert got == plain(docs)
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, g in got.items() if g[2])


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    rows = exact.exact_groups(df).collect()
    assert sorted((r["kept"], r["group_size"]) for r in rows) == [(False, 3), (True, 1), (True, 3), (True, 3)]
    assert sorted((r["doc_id"] or 0) for r in exact.drop_copies(df).collect()) == [0, 1]
    assert exact.exact_groups(df.limit(0)).count() == 0 and exact.drop_copies(df.limit(0)).count() == 0


def test_full_hashes_are_made_of_survivors_only(spark, monkeypatch):
    """The last level reads the texts that are left by length and prefix, and no others."""
    docs = [(i, "x" * i) for i in range(200)] + [(300, "abc"), (301, "a b c"), (302, "abd"), (303, "q" * 90 + "r"), (304, "q" * 90 + "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    read, full_keys = [], exact.full_keys
    monkeypatch.setattr(exact, "full_keys", lambda d, *a: read.append(sorted(r["doc_id"] for r in d.collect())) or full_keys(d, *a))
    kept = sorted(r["doc_id"] for r in exact.drop_copies(df).collect())
    assert read == [[300, 301, 303, 304]] and kept == sorted({i for i, _ in docs} - {300})


def test_rows_of_one_id_with_several_texts_and_clashing_names(spark):
    long = "word " * 400_000
    rows = [(1, "a", 1), (1, "b", 2), (1, "b ", 3), (2, "b", 4), (2, "c", 5), (3, "  c", 6), (None, "c", 7), (None, "d", 8), (4, long, 9), (5, long, 10), (6, None, 11), (7, " ", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_ int").withColumns({"of_": F.col("own_"), "id_": F.lit("x"), "kept_": F.lit(1)})
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["own_"] for r in kept.collect()) == [1, 3, 6, 8, 9, 12]
    got = sorted((r["doc_id"] or 0, r["kept"], r["group_size"]) for r in exact.exact_groups(df).collect())
    assert got == [(0, False, 3), (0, True, 1), (1, True, 1), (1, True, 3), (1, True, 3), (2, False, 3), (2, False, 3), (3, True, 3), (4, True, 2), (5, False, 2), (6, False, 2), (7, True, 2)]
