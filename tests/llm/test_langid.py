import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardspan.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op7_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_filter_has_every_learned_gram_and_few_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    assert model.languages == sorted(model.languages) and (model.false_rate < 0.05).all()
    odd = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    masks = np.full(len(odd), ~np.uint64(0))
    for at in langid.probes(odd):
        masks &= model.slots[0][at]
    for l in range(len(model.languages)):
        share = ((masks >> np.uint64(l)) & np.uint64(1)).mean()
        assert abs(share - model.false_rate[l]) < 0.02


def test_rows(spark):
    rows = [(i, f"the words of a text number {'abcdefgh'[i % 8] * 3}", "en", 1) for i in range(40)] + [(i, "los textos de una casa", "es", 1) for i in range(40, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df)
    asked = spark.createDataFrame([(1, "the text", 0), (2, "una casa", 0), (3, None, 0), (4, "", 0), (5, "12 !", 0), (7, "½ ² 3", 0), (6, "漢字", 0), (6, "漢字", 0)], "doc_id long, text string, l int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 7)] == ["en", "es", "und", "und", "und", "und"] and got[6][0] in ("en", "es") and got[6][1] == 0
    none = langid.fit(df.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(asked, none).collect()} == {"und"}
    assert langid.predict(asked.limit(0), model).count() == 0


def plain_grams(text):
    """The n-grams of the words of a text, a blank as the boundary on either side."""
    out = []
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for n in langid.SIZES:
        line = " " + " ".join(words) + " "
        out += [line[i : i + n] for i in range(len(line) - n + 1) if " " not in line[i + 1 : i + n - 1]]
    return out


def plain_model(rows):
    """Shares of each n-gram by language, of all rows, and the n-grams that stay."""
    counts = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(plain_grams(text))
    shares = {l: {g: n / sum(c.values()) for g, n in c.items()} for l, c in counts.items()}
    most = Counter()
    for s in shares.values():
        for g, x in s.items():
            most[g] = max(most[g], x) if x >= langid.MIN_SHARE else most[g]
    return {l: {g for g, x in s.items() if x >= langid.MIN_SHARE and x >= langid.MIN_PART * most[g]} for l, s in shares.items()}


def test_against_sets_of_grams(spark):
    """Without chance hits the corrected counts are those of plain sets; 70 languages need two words of a slot."""
    rng = random.Random(3)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    names, rows = [f"l{i:02}" for i in range(70)], []
    for i, name in enumerate(names):
        own = random.Random(i).sample(letters, 7)
        for j in range(6):
            words = ["".join(rng.choice(own) for _ in range(rng.randrange(2, 8))) for _ in range(30)]
            rows.append((100 * i + j, " ".join(words), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, l) for i, t, l in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    model, expected = langid.fit(df), plain_model(learned)
    assert model.languages == names and model.slots.shape == (2, langid.SLOTS)
    texts = [t for _, t, _ in rows] + ["", "1 2", "Q"]
    found, total = langid.scores(model, texts)
    pred, score = langid.decide(model, texts)
    for i, t in enumerate(texts):
        g = plain_grams(t)
        assert total[i] == len(g)
        want = np.array([sum(x in expected[l] for x in g) for l in names])
        assert np.abs(found[i] - want).max() <= 0.01 * len(g) + 0.01, t
        if want.max(initial=0) > np.sort(want)[-2] + 0.03 * len(g):
            assert pred[i] == names[want.argmax()] and abs(score[i] - want.max() / len(g)) < 0.02
    held = [(p, r[2]) for p, r in zip(pred, rows) if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(p == l for p, l in held) >= 0.9 * len(held)


def test_very_long_text(spark):
    df = spark.createDataFrame([(i, t, l) for i in range(30) for t, l in (("the words of a text", "en"), ("los textos de una casa", "es"))], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "the words of a text " * 100_000)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(asked, langid.fit(df)).collect()] == ["en"]


def test_too_many_labels_stop_with_a_message(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang has more than 3"):
        langid.fit(df)
    assert len(langid.fit(df.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 3).cast("string")))).languages) == 3
