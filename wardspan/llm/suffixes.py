"""Operator 8: repeated passages by a sparse suffix array.

Only suffixes at content-selected positions are kept: the minimisers of SEED-word
grams over windows, chosen so that every passage of ``min_words`` holds one.
Positions whose gram only one document has leave after a count; a document's
places of equal gram and surroundings are one row with a list, so that rows side
by side are of different documents. The others are sorted by their gram and what
follows it, and neighbours whose surroundings on both sides agree become pairs.

Neighbours of whole surroundings miss documents that agree on part of either
side. So where a gram has several surroundings, the suffixes that start up to
``min_words`` words before the gram's end are sorted too, by their first
``min_words`` words, and neighbours that share these become pairs: every
``min_words`` words in a row of a document that another one has hold a kept gram,
so one of the two sorts finds them. The pairs' matches are then extended left and
right on the whole texts.

The sorts are by range over key and document, so a passage that thousands of
documents share is dealt over many tasks; each row meets one neighbour, and a
task's last row meets the first of the next by a list of two rows for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.llm.base import cut, documents, explode_texts, join_summary, release
from wardspan.llm.minhash import mix

MIN_WORDS = 50
BASE = np.array([0x9E3779B97F4A7C15], np.uint64)  # an array, as its products wrap round

_WORD = re.compile(r"[^ \t-\r]+")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin (one more at the end)."""
    split = [t.encode().split() for t in texts]
    bounds = np.cumsum([0, *map(len, split)])
    words = [w for ws in split for w in ws]
    if not words:
        return np.zeros(0, np.uint64), bounds
    codes, unique = pd.factorize(np.array(words, object))
    return pd.util.hash_array(np.asarray(unique, object), categorize=False)[codes], bounds


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, by doubling; empty if there are fewer."""
    if len(h) < n:
        return h[:0]
    out, width, power, have = None, h, BASE, 1
    rest, done = n, 0
    while rest:
        if rest & 1:
            # what is done so far, followed by a run of ``have`` words
            m = len(h) - done - have + 1
            out = width[:m] if out is None else out[:m] * power + width[done : done + m]
            done += have
        rest >>= 1
        if rest:
            m = len(h) - 2 * have + 1
            width = width[:m] * power + width[have : have + m]
            power, have = power * power, 2 * have
    return mix(out[: len(h) - n + 1])


def slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of (minimum or maximum) over each n consecutive values, by doubling."""
    have = 1
    while 2 * have <= n:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of gram hashes that are least in a window of ``window``; runs of one value keep some."""
    if not len(g):
        return np.zeros(0, np.int64)
    if len(g) <= window:
        chosen = np.flatnonzero(g == g.min())
    else:
        least = slide(g, window, np.minimum)
        top = np.full(window - 1, np.uint64(0))
        best = slide(np.concatenate([top, least, top]), window, np.maximum)
        chosen = np.flatnonzero(best == g)
    inner = np.zeros(len(chosen), bool)
    if len(chosen) > 2:
        same = g[chosen]
        inner[1:-1] = (same[1:-1] == same[:-2]) & (same[1:-1] == same[2:]) & (np.diff(chosen)[:-1] == 1) & (np.diff(chosen)[1:] == 1)
    return chosen[~inner | (chosen % window == 0)]


def surroundings(h: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what follows the grams at ``at``, and of all that a passage of min_words with the gram can hold; text ends count."""
    seed, reach = min_words // 2, min_words - min_words // 2
    none = np.zeros(reach, np.uint64)
    padded = np.concatenate([none, h, none])
    after = gram_hashes(padded, reach)[at + reach + seed]
    return after.view(np.int64), gram_hashes(padded, seed + 2 * reach)[at].view(np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def by_value(places: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ordered by their values, where each value's places begin (one more at the end), and a place of each value."""
    order = np.lexsort((places, *values))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([v[order][1:] != v[order][:-1] for v in values], axis=0)
    first = np.flatnonzero(new)
    return places[order], np.append(first, len(order)), order[first]


def lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """A list column of (places, bounds) as by_value() gives them."""
    sizes = [np.diff(b) for _, b in parts]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if parts else np.zeros(1)
    places = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places.astype(np.int32)))


def seeds(df: DataFrame, min_words: int) -> DataFrame:
    """(gram, id, places, after, around) of the kept suffixes of texts (id, text); a text's places of equal gram and surroundings are one row."""
    seed, window = min_words // 2, min_words - min_words // 2 + 1

    def call(ids, texts):
        h, bounds = word_hashes(texts)
        rows, parts = [], []
        for i in range(len(ids)):
            own = h[bounds[i] : bounds[i + 1]]
            g = gram_hashes(own, seed)
            at = minimisers(g, window)
            if len(at):
                gram, (after, around) = g[at].view(np.int64), surroundings(own, at, min_words)
                places, bounds_, one = by_value(at, around, gram)
                parts.append((places, bounds_))
                rows.append((np.full(len(one), i), gram[one], after[one], around[one]))
        which, gram, after, around = map(np.concatenate, zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
        return {"gram": gram, "id": pa.array(ids, pa.int64()).take(pa.array(which)), "places": lists(parts), "after": after, "around": around}

    return explode_texts(df, lambda: call, "gram long, id long, places array<int>, after long, around long", "id", "text")


def neighbours(rows: DataFrame, order: list[str]) -> DataFrame:
    """Pairs (a, b, shift) of documents whose rows of equal key stand side by side in the order of ``order``, key and id.

    rows have a key, an id and the id's places. shift is the place in a less the
    place in b, with a the smaller id; each place of either row is in a shift.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        names = ["tag", "key", "a", "b", "shift", "places"]
        listed = pa.list_(pa.int32())

        def edge(tag, batch, at):
            key, doc, places = (batch.column(c).slice(at, 1) for c in range(3))
            return pa.RecordBatch.from_arrays([pa.array([tag], pa.int64()), key, doc, pa.nulls(1, doc.type), pa.nulls(1, pa.int64()), places.cast(listed)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield edge(2 * part, batch, 0)
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            key, ids, held = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks()
            at = np.flatnonzero((key[:-1] == key[1:]) & (ids[:-1] != ids[1:]))
            if len(at):
                counts, places = held.value_lengths().to_numpy(), held.flatten().to_numpy().astype(np.int64)
                starts = np.cumsum(counts) - counts
                n, m = counts[at], counts[at + 1] - 1
                left = places[spread(starts[at], n)] - np.repeat(places[starts[at + 1]], n)
                right = np.repeat(places[starts[at]], m) - places[spread(starts[at + 1] + 1, m)]
                which = np.concatenate([np.repeat(at, n), np.repeat(at, m)])
                k = len(which)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(k, -1), key[which], ids[which], ids[which + 1], np.concatenate([left, right]))] + [pa.nulls(k, listed)], names=names)
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            yield edge(2 * part + 1, last, 0)

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [*order, "key", "id"]
    ordered = rows.select("key", "id", "places", *order).repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    found = cut(ordered.mapInArrow(run, "tag long, key long, a long, b long, shift long, places array<int>"))
    # The edges: a first (even tag) and a last row for each task, so a key's window has two rows for each task that it reaches over.
    by_tag = W.partitionBy("key").orderBy("tag")
    edges = found.filter("tag >= 0").withColumns({f"{c}_": F.lag(c).over(by_tag) for c in ("tag", "a", "places")})
    shifts = F.expr("explode(array_union(transform(places_, p -> CAST(p - places[0] AS long)), transform(places, p -> CAST(places_[0] - p AS long))))")
    meeting = edges.filter("tag % 2 = 0 AND tag_ % 2 = 1 AND a_ <> a").select(F.col("a_").alias("a"), F.col("a").alias("b"), shifts.alias("shift"))
    pairs = found.filter("tag = -1").select("a", "b", "shift").unionByName(meeting)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") > F.col("b"), -F.col("shift")).otherwise(F.col("shift")).alias("shift"))


def open_places(shared: DataFrame) -> DataFrame:
    """(id, places) of the rows whose windows other surroundings of their gram may share.

    Rows of equal surroundings share all windows around the gram and have met in
    neighbours(), so the first and last document of each surroundings stand for
    them, and grams that have one surroundings only are done.
    """
    row = F.struct("id", "places")
    around = shared.groupBy("gram", "around").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    several = around.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    ends = join_summary(around, several, ["gram"]).select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("r"))
    return ends.select("r.id", "r.places")


def windows(texts: DataFrame, min_words: int) -> DataFrame:
    """(key, id, places) of all min_words words in a row around the texts' places; key is the words' hash."""
    seed = min_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                h, bounds = word_hashes(part.column(1).to_pylist())
                rows, parts = [], []
                for k, at in enumerate(part.column(2).to_pylist()):
                    g = gram_hashes(h[bounds[k] : bounds[k + 1]], min_words)
                    near = np.unique(np.add.outer(np.array(at, np.int64), np.arange(seed - min_words, 1)))
                    near = near[(near >= 0) & (near < len(g))]
                    if len(near):
                        key = g[near].view(np.int64)
                        places, bounds_, one = by_value(near, key)
                        parts.append((places, bounds_))
                        rows.append((np.full(len(one), k), key[one]))
                if rows:
                    which, key = map(np.concatenate, zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(which)), lists(parts)], names=["key", "id", "places"])

    return texts.filter("size(places) > 0").select("id", "text", "places").mapInArrow(run, "key long, id long, places array<int>")


def extended(x: np.ndarray, y: np.ndarray, shifts: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """Matches (start in x, start in y, words) of min_words at least, extended left and right along each shift."""
    out = []
    for shift in shifts:
        lo, hi = max(0, shift), min(len(x), len(y) + shift)
        bad = np.concatenate([[lo - 1], np.flatnonzero(x[lo:hi] != y[lo - shift : hi - shift]) + lo, [hi]])
        for k in np.flatnonzero(np.diff(bad) > min_words):
            a, b = int(bad[k]) + 1, int(bad[k + 1])
            out.append((a, a - shift, b - a))
    return out


class Words:
    """Word hashes of texts by number, and the characters at which words begin and end; the last few texts are kept."""

    def __init__(self, keep: int = 64, chars: int = 4 << 20) -> None:
        self.keep, self.chars, self.held, self.size = keep, chars, {}, 0

    def of(self, number: int, text: str) -> list:
        if number not in self.held:
            if len(self.held) >= self.keep or self.size + len(text) > self.chars:
                self.held, self.size = {}, 0
            self.held[number] = [word_hashes([text])[0], None, text]
            self.size += len(text)
        return self.held[number]

    @staticmethod
    def places(entry: list) -> list[tuple[int, int]]:
        if entry[1] is None:
            entry[1] = [m.span() for m in _WORD.finditer(entry[2])]
        return entry[1]


def repeated_passages(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end (code points), n_words, partner_id, matches: each stretch of a text that other documents repeat.

    Passages are min_words or more consecutive words (runs without white space).
    Overlapping matches of a document are one stretch; n_words is its longest
    match. A passage that only one document repeats within itself doesn't count,
    nor do null ids. Null, empty and shorter texts have none, nor has an empty
    table. Rows are told apart by id and text: rows of one id and text are one
    document, rows of one id with other texts are other documents, each with
    stretches of its own.
    """
    docs = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    docs = docs.select(F.xxhash64(id_col, text_col).alias("id"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kept = cut(seeds(docs, min_words))
    mark = F.xxhash64("id")
    counts = kept.groupBy("gram").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("gram")
    shared = cut(join_summary(kept, counts, ["gram"]))
    release(kept)
    near = neighbours(shared.withColumnRenamed("around", "key"), ["gram", "after"])
    spots = cut(open_places(shared))
    release(shared)
    wanted = spots.unionByName(near.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("places", F.lit(None).cast("array<int>")))
    wanted = wanted.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"))
    texts = cut(docs.join(wanted, "id").dropDuplicates(["id"]))
    around = cut(windows(texts, min_words))
    near = near.unionByName(neighbours(around, []))
    release(spots, around)
    # A pair has at most as many shifts as its texts have seeds and windows around them.
    pairs = cut(near.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")))
    side = lambda n: texts.select(F.col("id").alias(n), F.col("doc").alias(f"doc_{n}"), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            id_type = batch.schema.field(3).type
            types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), id_type]
            for i in range(0, batch.num_rows, 64):
                found = []
                for a, b, shifts, doc_a, doc_b, text_a, text_b in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    x, y = words.of(a, text_a), words.of(b, text_b)
                    for p, q, n in extended(x[0], y[0], shifts, min_words):
                        for own, doc, entry, at, other in ((a, doc_a, x, p, doc_b), (b, doc_b, y, q, doc_a)):
                            spans = words.places(entry)
                            found.append((own, doc, spans[at][0], spans[at + n - 1][1], n, other))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["id", "doc", "start", "end", "n_words", "partner_id"])

    spans = both.select("a", "b", "shifts", "doc_a", "doc_b", "text_a", "text_b").mapInArrow(run, f"id long, doc {kind}, start long, end long, n_words long, partner_id {kind}")
    order = W.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = islands.groupBy("id", "doc", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("n_words").alias("n_words"), F.min("partner_id").alias("partner_id"), F.count(F.lit(1)).alias("matches")
    )
    return merged.select(F.col("doc").alias(id_col), "start", "end", "n_words", "partner_id", "matches")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
