import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wardspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = list("aaaaabbeehtT  \n\t'sdrllve0123.,!-ÀéÉß÷×  ́\x1c\x1d\x00漢字日本😀<|>")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.read_ranks(PATH)
    return bpe.coder(bpe.tokenizer_json(PATH, public_tokenizers.PATTERN)), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), list(ranks)


def test_same_ids_as_the_ranks_library(pair):
    coder, other, tokens = pair
    rng = random.Random(7)
    for i in range(3000):
        if i % 2:
            text = "".join(rng.choice(ODD) for _ in range(rng.randrange(60)))
        else:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randrange(8))).decode("utf8", "ignore")
        ids = coder.encode(text)
        assert ids.tolist() == other.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_offsets_cover_characters(pair):
    text = "héllo 漢字😀 end"
    ids = pair[0].encode(text)
    first, end = pair[0].offsets(ids, text.encode())
    assert first[0] == 0 and end[-1] == len(text) and (np.diff(first) >= 0).all() and (end > first).all()
    assert (first[1:] <= end[:-1]).all()  # tokens inside one character share it


def test_split_character_decodes_to_replacement(pair):
    ids = pair[0].encode("😀")
    assert "�" in bpe.decode_text(pair[0].decode(ids[:1])) and bpe.decode_text(pair[0].decode(ids)) == "😀"


def test_rows(spark):
    long = "word " * 40_000
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, long, 9)], "doc_id long, text string, ids int")
    rows = bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()
    assert [r["n_tokens"] for r in sorted(rows, key=lambda r: r["doc_id"])][:4] == [2, 0, 0, 0] and len(rows) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["ids_sha256"] for r in rows if r["doc_id"] in (2, 3)} == {empty} == {r["decoded_sha256"] for r in rows if r["doc_id"] in (2, 3)}
    assert next(r["decoded_sha256"] for r in rows if r["doc_id"] == 4) == hashlib.sha256(long.encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    spans = bpe.encode_bpe(df, PATH, public_tokenizers.PATTERN, with_offsets=True).filter("doc_id = 1").first()
    assert (spans["char_start"], spans["char_end"]) == ([0, 1], [1, 3])
