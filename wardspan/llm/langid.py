"""Operator 7: language by n-gram filters with language bitmasks.

Learning counts character n-grams per language over a bounded sample of labelled
documents and keeps those with a minimum share. A Bloom filter, sliced so that
each slot holds one bit per language (as many words as they need), then returns
all languages that contain an n-gram by one AND of a few slots. A text's
popcounts per language, corrected for each language's false-positive rate,
decide.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import SLICE_ROWS, cut, documents, explode_texts, map_texts, slices

SIZES = (3, 4)
SLOTS = 1 << 18
PROBES = 3
#: Values of the label column at most; 64 of them take 2 MB of the model.
MOST_LANGUAGES = 4096
#: Documents per language that are learned from (about: by a hash of the id).
FIT_DOCS = 2000
#: Languages of one word of a slot.
WORD = 64
#: Characters whose n-grams are looked up at once (a longer text alone): about 100 bytes of arrays for each.
SCORE_CHARS = 1 << 17
#: An n-gram belongs to a language with this share of its n-grams, and this part of the share of the language that has most.
MIN_SHARE = 2e-5
MIN_PART = 0.1


class Model(NamedTuple):
    """Languages, words of bits (one row for each WORD languages, SLOTS columns), and each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside the words of all texts, and the text of each.

    Words are runs of letters, with one boundary on either side.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.append(owner, owner[-1:])
    points = np.where(letter_table()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points, owner = points[keep].astype(np.uint64), owner[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for i in range(n):
            part = points[i : i + m]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            if 0 < i < n - 1:
                inside &= part != 0
        h = h[inside]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        hashes.append(h)
        owners.append(owner[1 : 1 + m][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def probes(hashes: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(SLOTS.bit_length() - 1)
    return [((hashes >> (bits * np.uint64(i))) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def labelled(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows that may be learned from: with text and label, and crc32(id as text) mod 3 not 1."""
    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    return df.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """A model of the languages in label_col, of any number; what reaches the driver is bounded by languages / MIN_SHARE.

    More than MOST_LANGUAGES are an error, as the model goes to every task. It is
    learned from about ``fit_docs`` documents of each language. Null and
    empty texts and null labels teach nothing; a repeated row counts as often as
    it occurs, and without labelled rows the model has no languages.
    """
    known = labelled(df, id_col, text_col, label_col)
    sizes = known.groupBy(F.col(label_col).alias("l")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{label_col} has more than {MOST_LANGUAGES} values, for which a model is not made: is it the right column?")
    languages = sorted(r["l"] for r in sizes)
    if not languages:
        return Model([], np.zeros((0, SLOTS), np.uint64), np.zeros(0))
    number = {l: i for i, l in enumerate(languages)}
    rates = {r["l"]: min(1.0, fit_docs / r["count"]) for r in sizes}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col(label_col))
    drawn = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 20)) < rate * (1 << 20)
    sample = known.filter(drawn).select(F.struct(F.col(label_col)).alias("key"), F.col(text_col).alias("text"))

    def counter():
        def call(keys, texts):
            which = np.array([number[k[label_col]] for k in keys])
            h, owner = grams(texts)
            order = np.lexsort((h, which[owner]))
            h, lang = h[order], which[owner][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])
            starts = np.flatnonzero(new)
            return {"l": lang[starts].astype(np.int32), "gram": h[starts].view(np.int64), "n": np.diff(np.append(starts, len(h)))}

        return call

    counts = explode_texts(sample, counter, "l int, gram long, n long", "key").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "l").select("l", "gram", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") >= MIN_SHARE)
    most = frequent.groupBy("gram").agg(F.max("share").alias("most"))
    kept = frequent.join(most, "gram").filter(F.col("share") >= MIN_PART * F.col("most")).select("l", "gram").toPandas()
    return built(languages, kept["l"].to_numpy(np.int64), kept["gram"].to_numpy(np.int64).view(np.uint64))


def built(languages: list[str], which: np.ndarray, grams_: np.ndarray) -> Model:
    """The filter of n-gram hashes and the numbers of their languages."""
    slots = np.zeros((-(-len(languages) // WORD), SLOTS), np.uint64)
    rate = np.zeros(len(languages))
    for l in range(len(languages)):
        word, bit = slots[l // WORD], np.uint64(l % WORD)
        for at in probes(grams_[which == l]):
            word[at] |= np.uint64(1) << bit
        rate[l] = ((word >> bit) & np.uint64(1)).mean() ** PROBES
    return Model(languages, slots, rate)


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected counts (texts by languages), and n-grams of each text."""
    h, owner = grams(texts)
    total = np.bincount(owner, minlength=len(texts)).astype(float)
    out, places = np.zeros((len(texts), len(model.languages))), probes(h)
    for w, word in enumerate(model.slots):
        masks = np.full(len(h), ~np.uint64(0), np.uint64)
        for at in places:
            masks &= word[at]
        for l in range(w * WORD, min(len(model.languages), (w + 1) * WORD)):
            hits = np.bincount(owner[((masks >> np.uint64(l % WORD)) & np.uint64(1)).astype(bool)], minlength=len(texts))
            rate = min(model.false_rate[l], 0.999)
            out[:, l] = (hits - rate * total) / (1 - rate)
    return out, total


def decide(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not model.languages or not texts:
        return ["und"] * len(texts), np.zeros(len(texts))
    found, total = map(np.concatenate, zip(*(scores(model, part) for _, part in slices(texts, texts, SCORE_CHARS))))
    best = found.argmax(axis=1)
    has = [any(map(str.isalpha, t)) for t in texts]
    share = np.clip(found[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
    return [model.languages[b] if y else "und" for b, y in zip(best, has)], np.where(has, share, 0.0)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score, the share of n-grams in the language's filter.

    Null texts, texts without a letter and models without languages give ``und``
    and 0; ties go to the language that sorts first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def call(texts):
            pred, score = decide(known, texts)
            return {"lang_pred": pa.array(pred, pa.string()), "score": score}

        return call

    return map_texts(df, make, "lang_pred string, score double", id_col, text_col)


def language_of(model: Model, spark: SparkSession):
    """A function of a text column that gives a struct of lang_pred and score, as predict() has them; null is ``und``."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def call(texts: pa.Array) -> pa.Array:
        known, pred, score = shared.value, [], []
        for start in range(0, len(texts), SLICE_ROWS):
            p, s = decide(known, [t or "" for t in texts.slice(start, SLICE_ROWS).to_pylist()])
            pred += p
            score.append(s)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["lang_pred", "score"])

    return call.asNondeterministic()  # else a filter on it and a projection of it each run it


def has_letter(text_col: str) -> Column:
    """Whether a text has a letter."""
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
