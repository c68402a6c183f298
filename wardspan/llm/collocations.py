"""Operator 11: collocations of two to five words, by sorted binary keys.

Frequent words get numbers; other words and punctuation break the text. Each
place becomes one key: the numbers of the words from there on, five at most, in a
fixed width, filled up with zeros behind a break. Equal keys of a block are
counted where they lie, ranges of sorted keys go to one task each, and there a
radix sort and run lengths give the counts of all phrases, as a phrase is the
beginning of its keys. A run at a range's edge may go on in the next one, so a
last sum by phrase puts the edges together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.llm.base import cut, documents, join_summary, release

#: Words of the longest phrase, the least count of a phrase, and rows of a language's report.
WORDS, LEAST, TOP = 5, 100, 2000
#: A longer phrase with this percentage of a phrase's count replaces it.
REPLACES = 100
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20
#: Distinct words that a task counts, and about so many bytes of them, before it hands them on.
COUNTED, COUNTED_BYTES = 200_000, 16 << 20
#: Words and bytes of a dictionary that goes to all tasks; a larger one comes to each block of texts by a join.
SHIPPED, SHIPPED_BYTES = 400_000, 8 << 20
#: Bytes of a block of texts that gets a dictionary of its own.
BLOCK_BYTES = 8 << 20
#: Places whose keys are sorted at once, and keys of a range where the session has no more partitions.
PLACES, RANGE_KEYS = 1 << 21, 1 << 22
#: Places that are looked at, and keys that reach the driver, to find equal ranges; counts are of all places.
SAMPLED, SAMPLE = 4_000_000, 100_000
#: Parts of a language whose best phrases are ranked apart first.
PARTS = 64

# Bytes that end a piece become a full stop, the only mark left, and tabs become blanks.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if b in _ENDS else ord(" ") if b == 9 else b for b in range(256))
_MARK = re.compile(rb"[ .]")


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words in lower case (of A-Z alone) and b"." for every end of a piece, in lists of a stretch each."""
    data = text.encode().lower().translate(_TABLE)
    start = 0
    while start < len(data):
        mark = _MARK.search(data, start + STRETCH)
        end = mark.start() if mark else len(data)
        yield data[start:end].replace(b".", b" . ").split()
        start = end


def texts_of(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang (null: und) and text (null: empty)."""
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """lang and text; texts become Python's one by one."""
    for batch in batches:
        yield from zip(batch.column("lang").to_pylist(), (t.as_py() for t in batch.column("text")))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word and its count c, and a language's words in all under the empty word; a task's counts are summed up before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, of in counts.items():
                of.pop(b".", None)
                of[b""] = of.total()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.array(list(of), pa.binary()).cast(pa.string()), pa.array(list(of.values()), pa.int64())], names=["lang", "word", "c"])
            counts.clear()

        for lang, text in rows_of(batches):
            for words in words_of(text):
                of = counts.setdefault(lang, Counter())
                before = len(of)
                of.update(words)
                new = len(of) - before
                held, size = held + new, size + new * min(STRETCH, len(text)) // max(1, len(words))
                if held >= COUNTED or size >= COUNTED_BYTES:
                    yield from told()
                    held = size = 0
        yield from told()

    return texts.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def digits_for(n: int) -> int:
    """16-bit digits that a number of 0 to n takes."""
    return max(1, -(-n.bit_length() // 16))


def keys_of(numbers: np.ndarray, begins: int, digits: int, words: int) -> np.ndarray:
    """The keys of the first ``begins`` places that two words or more follow without a break (0): ``words`` times ``digits`` columns, the highest digit first."""
    ahead = np.concatenate([numbers, np.zeros(words, numbers.dtype)])
    at = np.flatnonzero((ahead[:begins] > 0) & (ahead[1 : begins + 1] > 0))
    out, open_ = np.zeros((len(at), words * digits), np.uint16), np.ones(len(at), bool)
    for k in range(words):
        word = ahead[at + k]
        open_ &= word > 0
        word = np.where(open_, word, 0)
        for j in range(digits):
            out[:, k * digits + j] = word >> 16 * (digits - 1 - j) & 0xFFFF
    return out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the rows by all columns: one stable pass for each 16-bit digit, from the last."""
    order = np.argsort(keys[:, -1], kind="stable")
    for k in range(keys.shape[1] - 2, -1, -1):
        order = order[np.argsort(keys[order, k], kind="stable")]
    return order


def changes(keys: np.ndarray) -> np.ndarray:
    """For each sorted row the first column in which it differs from the row before: 0 for the first row, the number of columns where none does."""
    first = np.zeros(len(keys), np.int64)
    if len(keys):
        differ = keys[1:] != keys[:-1]
        first[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return first


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = radix_order(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(changes(keys) < keys.shape[1])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """The keys as one column of bytes, which compare as the numbers do."""
    return np.ascontiguousarray(keys.astype(">u2")).view(f"S{2 * keys.shape[1]}").ravel()


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, compressed: the columns one by one as differences of rows, low bytes apart from high ones."""
    steps = np.diff(keys, axis=0, prepend=np.zeros((1, keys.shape[1]), np.uint16)).T
    planes = np.concatenate([(steps & 0xFF).astype(np.uint8).ravel(), (steps >> 8).astype(np.uint8).ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """n keys and their counts of packed()."""
    planes = np.frombuffer(pa.decompress(data, n * (2 * columns + 4), codec="zstd", asbytes=True), np.uint8)
    low, high = planes[: 2 * n * columns].reshape(2, columns, n).astype(np.uint16)
    keys = np.cumsum(low | high << 8, axis=1, dtype=np.uint16).T
    return keys, np.ascontiguousarray(planes[2 * n * columns :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


@dataclass
class Coder:
    digits: int
    words: int

    def blocks(self, rows: Iterator[tuple[str, str]], known: dict[str, dict[bytes, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct sorted keys and their counts, of PLACES places at a time; a block's last places lie in the next one too, where their keys begin."""
        held, size = [], 0
        for lang, text in rows:
            number = known.get(lang, {}).get
            for words in words_of(text):
                held.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
                size += len(words)
                if size >= PLACES:
                    numbers = np.concatenate(held)
                    whole = len(numbers) - self.words + 1
                    yield self.block(numbers, whole)
                    held, size = [numbers[whole:]], self.words - 1
            held.append(np.zeros(1, np.int64))
            size += 1
        if held:
            numbers = np.concatenate(held)
            yield self.block(numbers, len(numbers))

    def block(self, numbers: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray]:
        keys = keys_of(numbers, begins, self.digits, self.words)
        return summed(keys, np.ones(len(keys), np.int64))


@dataclass
class Sample:
    """Every ``step``-th key of the places, from one by chance on."""

    step: int
    schema = "key binary"

    def __call__(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        at = int(np.random.default_rng(TaskContext.get().partitionId()).integers(self.step))
        for keys, counts in blocks:
            ends = np.cumsum(counts)
            marks = np.arange(at, ends[-1] if len(ends) else 0, self.step)
            at = int(marks[-1] + self.step if len(marks) else at) - int(ends[-1] if len(ends) else 0)
            chosen = keys[np.searchsorted(ends, marks, "right")].astype(">u2")
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in chosen], pa.binary())], names=["key"])


@dataclass
class Ranged:
    """Each block's keys by range: the range's number, how many keys there are, and they with their counts, packed."""

    splits: np.ndarray
    schema = "part int, n int, keys binary"

    def __call__(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for keys, counts in blocks:
            if len(keys):
                ends = [0, *np.searchsorted(as_bytes(keys), self.splits), len(keys)]
                part, n, data = zip(*[(i, b - a, packed(keys[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["part", "n", "keys"])


def shipped(dictionary: DataFrame) -> dict[str, dict[bytes, int]] | None:
    """The dictionary by language where it is small enough for every task, else None."""
    size = dictionary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0))).first()
    if size[0] > SHIPPED or size[1] > SHIPPED_BYTES:
        return None
    known: dict[str, dict[bytes, int]] = {}
    for r in dictionary.select("id", "lang", "word").toLocalIterator():
        known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
    return known


def with_own_dictionaries(texts: DataFrame, dictionary: DataFrame, coder: Coder, send: Callable) -> DataFrame:
    """send()'s rows over blocks of texts, each with the part of the dictionary that it needs: its distinct words are joined, then both meet by block."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = cut(texts.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, (lang, text) in zip(batch.column("block").to_pylist(), rows_of(iter([batch]))):
                for words in words_of(text):
                    words = list(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string())], names=["block", "lang", "word"])

    used = dealt.mapInArrow(distinct, "block long, lang string, word string").distinct()
    own = join_summary(used, dictionary.select("lang", "word", "id"), ["lang", "word"])

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(right["lang"].to_pylist(), right["word"].to_pylist(), right["id"].to_pylist()):
            known.setdefault(lang, {})[word.encode()] = number
        found = [b for b in send(coder.blocks(rows_of(iter(left.to_batches())), known))]
        return pa.Table.from_batches(found) if found else pa.table({n: [] for n in names})

    names = [c.split()[0] for c in send.schema.split(", ")]
    return dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(both, send.schema)


def phrase_counts(batches: Iterator[pa.RecordBatch], coder: Coder, least: int) -> Iterator[pa.RecordBatch]:
    """phrase (its part of a key) and a of one range: runs of ``least`` places or more, and those at the edges whatever their length."""
    got = [unpacked(k, n, coder.words * coder.digits) for b in batches for k, n in zip(b.column("keys").to_pylist(), b.column("n").to_pylist())]
    if not got:
        return
    keys, counts = summed(*map(np.concatenate, zip(*got)))
    new, digits = changes(keys), coder.digits
    for m in range(2, coder.words + 1):
        starts = np.flatnonzero(new < m * digits)
        runs = np.add.reduceat(counts, starts)
        told = runs >= least
        told[[0, -1]] = True
        told &= keys[starts, (m - 1) * digits : m * digits].any(axis=1)
        chosen = keys[starts[told], : m * digits].astype(">u2")
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in chosen], pa.binary()), pa.array(runs[told], pa.int64())], names=["phrase", "a"])


def frequent_phrases(texts: DataFrame, dictionary: DataFrame, coder: Coder, places: int, least: int) -> DataFrame:
    """phrase and a: all phrases of two words or more that occur ``least`` times, however often they cross blocks and ranges."""
    spark = texts.sparkSession
    known = shipped(dictionary)
    if known is not None:
        everywhere = spark.sparkContext.broadcast(known)

    def coded(texts: DataFrame, send: Callable) -> DataFrame:
        if known is None:
            return with_own_dictionaries(texts, dictionary, coder, send)
        return texts.mapInArrow(lambda batches: send(coder.blocks(rows_of(batches), everywhere.value)), send.schema)

    share = min(1.0, SAMPLED / max(1, places))
    some = texts if share == 1 else texts.sample(share, seed=11)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // RANGE_KEYS))
    width = 2 * coder.words * coder.digits
    sampled = np.sort(np.array([r["key"] for r in coded(some, Sample(max(1, int(share * places) // SAMPLE))).toLocalIterator()], f"S{width}"))
    splits = np.unique(sampled[[len(sampled) * i // ranges for i in range(1, ranges)]]) if len(sampled) else sampled
    dealt = coded(texts, Ranged(splits)).repartitionById(len(splits) + 1, F.col("part"))
    found = dealt.mapInArrow(lambda batches: phrase_counts(batches, coder, least), "phrase binary, a long")
    return found.groupBy("phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, least: int = LEAST, top: int = TOP, replaces: int = REPLACES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first ``top`` phrases.

    A phrase of 2 to ``words`` words occurs a >= ``least`` times within pieces;
    its parts l and r times. The cut of the lowest score floor(1000 a n / (l r))
    counts, the first of several. Phrases that lie in a longer one with
    ``replaces`` per cent of their count go. Order: score, a, then the phrase's
    bytes. Null languages are und; null and empty texts have no words; repeated
    rows count as often as they occur; an empty table gives no rows. Other
    columns aren't read.
    """
    texts = texts_of(df, lang_col, text_col)
    told = cut(word_counts(texts).filter((F.col("c") >= least) | (F.col("word") == "")))
    totals = told.filter("word = ''").select("lang", F.col("c").alias("n"))
    numbers = told.filter("word <> ''").rdd.zipWithIndex().map(lambda p: (p[1] + 1, *p[0]))
    dictionary = cut(numbers.toDF("id long, lang string, word string, c long"))
    known, places = dictionary.count(), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    coder = Coder(digits_for(known), words)
    width = 2 * coder.digits
    single = dictionary.select(F.unhex(F.lpad(F.hex("id"), 2 * width, "0")).alias("phrase"), "lang", "word", "c")
    found = cut(frequent_phrases(texts, dictionary, coder, places, least))

    def part(key: Column, start: Column, n: Column) -> Column:
        """n words of a phrase from a place on, from 1."""
        return F.substring(key, (start - 1) * width + 1, n * width)

    size = (F.octet_length("phrase") / width).cast("int")
    one = F.lit(1)

    # Phrases that a longer one replaces.
    inner = found.withColumn("m", size).filter("m > 2").select("a", "phrase", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inner = inner.select("a", "phrase", "k", F.explode(F.sequence(one, F.col("m") - F.col("k") + 1)).alias("at"))
    longer = inner.groupBy(part(F.col("phrase"), F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = found.join(longer, "phrase", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < replaces * F.col("a"))).drop("longer")

    # Words and language of a phrase.
    places_of = kept.select("phrase", "a", F.explode(F.sequence(one, size)).alias("at"))
    spelled = join_summary(places_of.withColumn("word_", part(F.col("phrase"), F.col("at"), one)), single.select(F.col("phrase").alias("word_"), "lang", "word"), ["word_"])
    in_order = F.array_sort(F.collect_list(F.struct("at", "word")))
    spelled = spelled.groupBy("phrase", "a").agg(F.first("lang").alias("lang"), in_order.alias("w"))
    spelled = join_summary(spelled.select("phrase", "a", "lang", F.array_join(F.transform("w", lambda x: x.word), " ").alias("text")), totals, ["lang"])

    # The lowest of its cuts.
    counts = found.unionByName(single.select("phrase", F.col("c").alias("a")))
    cuts = spelled.withColumn("m", size).select("*", F.explode(F.sequence(one, F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"l_": part(F.col("phrase"), one, F.col("k")), "r_": part(F.col("phrase"), F.col("k") + 1, F.col("m") - F.col("k"))})
    cuts = join_summary(cuts, counts.select(F.col("phrase").alias("l_"), F.col("a").alias("l")), ["l_"])
    cuts = join_summary(cuts, counts.select(F.col("phrase").alias("r_"), F.col("a").alias("r")), ["r_"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(1000 AS decimal(4,0)) * a_ * n_) div (l_ * r_)")
    cuts = cuts.withColumns({f"{c}_": exact(c) for c in "anlr"}).withColumn("score", score)
    best = cuts.groupBy("phrase", "lang", "text", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", F.col("text").alias("phrase"), "a", "b.l", "b.r", "n", "b.score", F.pmod(F.xxhash64("text"), F.lit(PARTS)).alias("part"))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
