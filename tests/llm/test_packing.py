import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wardspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library():
    coder, other, rng = packing.coder(open(PATH).read()), library(), random.Random(1)
    odd = list("aaaaabbeehtT  \n\t'sdrllve0123.,!-ÀéÉß÷×  ́\x1c\x1d\x00漢字日本😀<|>_²ªİΣς")
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "x" * 60]
    for i in range(4000):
        text = "".join(rng.choice(odd + marks * (i % 4)) for _ in range(rng.randrange(40)))
        assert coder.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_a_small_table_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "TABLE_SLOTS", 16)
    monkeypatch.setattr(packing, "TABLE_RUN", 7)
    coder, other, rng = packing.WordBpe(open(PATH).read()), library(), random.Random(2)
    words = ["the", "THE", "ÀÉß", "x" * 16, "x" * 17, "é" * 16, "Straßenbahnhaltestelle", "y" * 60, "a1b22", "!!", "!!!", "a.b", "", "\t", "\n\r "]
    for _ in range(60):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice(["", "", "日本", "<|endoftext|>"]) for _ in range(rng.randrange(6))]
        found = coder.encode_all(texts)
        assert [x.tolist() for x in found] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_frequent_words_are_encoded_few_times():
    coder, calls = packing.WordBpe(open(PATH).read()), []

    class Model:
        tokenize = staticmethod(lambda piece, whole=coder.model: calls.append(piece) or whole.tokenize(piece))

    coder.model = Model
    names = ["".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(180_000)]
    frequent, others = names[:20_000], names[20_000:]
    for start in range(0, len(others), 8_000):
        coder.encode(" ".join(frequent + others[start : start + 8_000]))
    assert len(calls) <= len(others) + 3 * len(frequent)


def check(rows, texts, most_padding):
    other, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*other.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= most_padding * total


def test_small_table(spark):
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 30_000, 5: "x y " * 500, 6: "end<|endoftext|>start <|startoftext|>" * 300}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, start int")
    check(packing.pack_documents(df, PATH).collect(), texts, 0.01)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    ids = packing.pack_documents(df.filter("doc_id = 1"), PATH, with_ids=True).collect()
    assert sum((r["ids"] for r in sorted(ids, key=lambda r: r["start"])), [])[-1] == 1


def test_documents(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check(packing.op9_harmonic_packing(spark, small).collect(), texts, 0.01)


def test_cuts():
    for n in range(1, 9000, 7):
        assert sum(packing.cuts(n, 2048, 64)) == n
