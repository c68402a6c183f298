from pyspark.sql import functions as F

import corpus_pipeline as P
from wardspan.llm import pii


def test_stages(spark):
    words = "the words of this text are plain and there is nothing else to say about it at all".split()
    base = " ".join(words * 6 + [f"x{i}" for i in range(60)])
    rows = [
        (1, base, "en", "s", 0), (2, base + "  ", None, "s", 0), (3, base + " extra", "en", "s", 0), (4, "12345 !!", "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0),
        (7, "write to the plain text a@b.cd about this", "en", "s", 0), (7, "write to the plain text a@b.cd about this", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = P.language(spark, docs, "")
    assert told.columns == docs.columns and sorted(r["doc_id"] for r in told.collect()) == [1, 2, 3, 7, 7]
    whole = P.exact_copies(spark, told, "")
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 3, 7]
    near = P.near_copies(spark, whole, "")
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [2, 7]
    masked = P.personal_data(spark, near, "")
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert text[7] == ("write to the plain text <EMAIL> about this", 42) and pii.spans_of(text[2][0]) == []
    packed = P.sequences(spark, masked, "").collect()
    assert {r["doc_id"] for r in packed} == {2, 7}


def test_run(spark, small):
    rows = P.run(spark, small).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= docs and len(P.STAGES) == 5


def test_clashing_names_long_texts_and_unlabelled_rows(spark):
    names = ["told_", "gone_", "of_", "own_", "id_", "kept_", "doc", "id"]
    text = "plain words of a text that nobody copied so far"
    rows = [(1, text, None, "s", 0), (2, text + " ", None, "s", 0), (3, "long text of many words " * 50_000, None, "s", 0), (4, None, None, "s", 0), (5, "", None, None, None), (None, "some other words", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for labelled in (docs, docs.withColumn("lang", F.lit("en"))):
        kept = labelled
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, "")
            assert kept.columns == docs.columns
        kept = sorted(kept.collect(), key=lambda r: r["doc_id"] or 0)
        assert [r["doc_id"] for r in kept][-2:] == [2, 3] and all(r[n] == f"{n}{r['doc_id']}" for r in kept if r["doc_id"] for n in names)
        assert kept[-1]["n_chars"] == len(rows[2][1])
    packed = P.sequences(spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5, None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "sequences" or out.columns == docs.columns)


def test_run_is_a_plain_chain_of_its_stages(spark, small):
    """Everything after the first stage again, document by document."""
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = {r["doc_id"]: r["text"] or "" for r in P.language(spark, docs, small).collect()}
    assert len(known) > 100
    groups = {}
    for i, text in known.items():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text), []).append(i)
    kept = sorted(min(ids, key=lambda i: (-len(known[i]), i)) for ids in groups.values())

    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, least = {i: shingles(known[i]) for i in kept}, {i: i for i in kept}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, a in enumerate(kept):
        for b in kept[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    kept = [i for i in kept if least[i] == i]
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(encoder.encode(pii.masked(known[i]), add_special_tokens=False).ids) + 1 for i in kept}
    rows = P.run(spark, small).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == want
    assert sum(r["length"] for r in rows) == sum(want.values()) and len(known) - len(want) > 0
