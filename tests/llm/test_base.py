import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from wardspan.llm import base, bpe, langid


@pytest.fixture
def batch_setting(spark):
    before = spark.conf.get(base.BATCH_SETTING)
    yield spark.conf
    spark.conf.set(base.BATCH_SETTING, before)


def test_slices_of_a_batch_are_small_and_whole():
    texts = ["x" * 5_000] * 3_000 + ["", "y" * (2 * base.SLICE_CHARS), "", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(base.batch_slices(batch))
    assert [i for ids, _ in parts for i in ids] == list(range(len(texts))) and [t for _, found in parts for t in found] == texts
    assert all(len(found) <= base.SLICE_ROWS and (len(found) == 1 or sum(map(len, found)) <= 1 << 20) for _, found in parts)


def test_pieces_are_forgotten_in_time():
    cache = bpe.PieceCache(lambda p: [int(p), len(p)])
    for start in range(0, 300_000, 1_000):
        pieces = [str(i) for i in (7, *range(start, start + 1_000), 7)]
        assert cache.encode(pieces).tolist() == [x for p in pieces for x in (int(p), len(p))]
        assert len(cache.at) <= 1 << 16 and len(cache.starts) <= 1 << 16


def test_frequent_pieces_outlast_others():
    calls = []
    cache = bpe.PieceCache(lambda p: calls.append(p) or [int(p)])
    for start in range(20_000, 300_000, 5_000):
        pieces = [str(i) for i in (*range(20_000), *range(start, start + 5_000))]
        assert cache.encode(pieces).tolist() == [int(p) for p in pieces]
    assert len(calls) == 300_000


def test_long_pieces_are_encoded_but_not_kept():
    cache = bpe.PieceCache(lambda p: [len(p)] * (len(p) % 3))
    pieces = ["a" * (i % 60 + 1) for i in range(100_000)]
    assert cache.encode(pieces).tolist() == [n for p in pieces for n in [len(p)] * (len(p) % 3)]
    assert max(map(len, cache.at)) == bpe.CACHE_CHARS and cache.encode([]).tolist() == []


def test_scores_of_long_runs_are_those_of_single_texts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (20_000, 3, 9_000, 9_000, 50, 0)]
    known = langid.grams(words)[0]
    model = langid.built(["a", "b"], np.arange(len(known)) % 2, known)
    seen, whole = [], langid.grams
    try:
        langid.grams = lambda part: seen.append(part) or whole(part)
        pred, score = langid.decide(model, texts)
    finally:
        langid.grams = whole
    assert [t for part in seen for t in part] == texts and all(len(part) == 1 or sum(map(len, part)) <= langid.SCORE_CHARS for part in seen)
    assert len(seen) > 1
    for t, p, s in zip(texts, pred, score):
        alone = langid.decide(model, [t])
        assert (alone[0][0], alone[1][0]) == (p, s)
    assert langid.decide(model, [])[0] == []


def test_stages_bound_arrow_batches(spark, batch_setting):
    docs = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))

    def widest():
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "rows"]) for b in batches), "size long, rows long")
        return sizes.agg(F.max("size"), F.sum("rows")).collect()[0]

    assert widest()[0] > 8_000_000
    for name, stage in P.STAGES:
        spark.conf.set(base.BATCH_SETTING, "64m")
        out = stage(spark, docs.limit(5), "")
        if name != "exact_copies":  # nothing of it goes to Python
            assert widest()[0] <= 1.5 * base.BATCH_BYTES and widest()[1] == 4_000
        assert out.count() >= 1


def test_smaller_batches_of_the_session_stay(spark, batch_setting):
    for told, then in (("64m", str(base.BATCH_BYTES)), ("512k", "512k"), ("1000", "1000"), ("2m", str(base.BATCH_BYTES))):
        batch_setting.set(base.BATCH_SETTING, told)
        base.bounded_batches(spark)
        assert batch_setting.get(base.BATCH_SETTING).removesuffix("b") == then
