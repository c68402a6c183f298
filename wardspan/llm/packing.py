"""Operator 9: harmonic packing of tokenised documents into sequences.

A document's tokens are cut into whole sequences, then halves, quarters and so
on down to ``min_cut``; the rest is a tail. A piece of length L belongs to class
j = capacity // L, and a sequence of class j takes exactly j pieces of it. Every
task fills its own classes, so there is no shuffle and no shared state. What
is open at a task's end (a bounded number of pieces) is laid end to end, cut
where a sequence is full, and the last of it closed at powers of two.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import batch_slices, documents
from wardspan.llm.bpe import LETTERS, PUNCTUATION, PieceCache, byte_table, lists

CAPACITY = 2048
MIN_CUT = 64
END_ID = 1

_PLAIN = re.compile(rf"[{LETTERS}0-9{PUNCTUATION} \t-\r]*\Z")
_MATCH = re.compile(rf"[{LETTERS}]+|[0-9]|[{PUNCTUATION}]+")

# The classes of a plain text's Latin-1 bytes: white space, letters, punctuation, digits.
_DIGIT = 3
_CLASSES = np.zeros(256, np.uint8)
for _kind, _letters in enumerate((LETTERS, PUNCTUATION, "0-9"), 1):
    _CLASSES[[b for b in range(256) if re.match(f"[{_letters}]", chr(b))]] = _kind
# What of 8 bytes, loaded little-endian, belongs to a word with so many left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Slots of the table of words in one worker, the longest word in it, and the words looked up at a time.
TABLE_SLOTS = 1 << 18
TABLE_BYTES = 16
TABLE_RUN = 1 << 15


class WordTable:
    """Ids of short Latin-1 words, looked up many at a time; a word has one slot, and keeps it against one other word once it was met again.

    A word's 16 bytes are its key, so an entry is right or another word's, never
    nearly right. Memory is fixed: some 82 bytes for each slot.
    """

    def __init__(self, encode_word, encode_long) -> None:
        #: The ids of a word as a list, and of one over TABLE_BYTES.
        self.encode_word, self.encode_long = encode_word, encode_long
        self.low, self.high = np.zeros(TABLE_SLOTS, np.uint64), np.zeros(TABLE_SLOTS, np.uint64)
        self.counts, self.met = np.zeros(TABLE_SLOTS, np.uint8), np.zeros(TABLE_SLOTS, bool)
        self.ids = np.zeros((TABLE_SLOTS, TABLE_BYTES), np.uint32)
        self.shift = np.uint64(64 - (TABLE_SLOTS.bit_length() - 1))

    def run(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and how many are each one's; data ends with TABLE_BYTES others."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low = words[starts] & _MASKS[np.minimum(sizes, 8)]
        high = words[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        slots = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        long = sizes > TABLE_BYTES
        counts, ids = self.counts[slots].astype(np.int64), self.ids[slots]
        known = (self.low[slots] == low) & (self.high[slots] == high)
        self.met[slots[known]] = True
        missing = np.flatnonzero(~(known | long))
        if len(missing):
            new: dict[bytes, list[int]] = {}
            found = []
            for a, n in zip(starts[missing].tolist(), sizes[missing].tolist()):
                word = data[a : a + n]
                if word not in new:
                    new[word] = self.encode_word(word.decode("latin-1"))
                found.append(new[word])
            counts[missing] = np.fromiter(map(len, found), np.int64, len(found))
            rows = np.zeros((len(found), TABLE_BYTES), np.uint32)
            rows[np.arange(TABLE_BYTES) < counts[missing, None]] = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
            ids[missing] = rows
            # Of the words that come to one slot here, one for all columns.
            at, first = np.unique(slots[missing], return_index=True)
            free = ~self.met[at]
            self.met[at] = False
            at, first = at[free], first[free]
            self.low[at], self.high[at] = low[missing[first]], high[missing[first]]
            self.counts[at], self.ids[at] = counts[missing[first]], rows[first]
        counts[long] = 0
        flat = ids[np.arange(TABLE_BYTES) < counts[:, None]]
        if long.any():
            where, before = np.flatnonzero(long), np.cumsum(counts)
            found = [self.encode_long(data[a : a + n].decode("latin-1")) for a, n in zip(starts[where].tolist(), sizes[where].tolist())]
            counts[where] = [len(x) for x in found]
            flat = np.insert(flat, np.repeat(before[where], counts[where]), np.concatenate(found))
        return flat, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each plain text in lower case; the arrays are parts of one."""
        parts = [t.encode("latin-1") for t in texts]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        data = b"\n".join([*parts, bytes(TABLE_BYTES)])
        kinds = _CLASSES[np.frombuffer(data, np.uint8)]
        bounds = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)) + 1
        bounds = np.concatenate([[0], bounds, [len(data)]])
        words = kinds[bounds[:-1]] > 0
        starts, sizes = bounds[:-1][words], np.diff(bounds)[words]
        found = [self.run(data, starts[i : i + TABLE_RUN], sizes[i : i + TABLE_RUN]) for i in range(0, len(starts), TABLE_RUN)]
        if not found:
            return [np.zeros(0, np.uint32) for _ in texts]
        ids, counts = zip(*found)
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        ends = before[np.searchsorted(starts, begins)]
        ids = np.concatenate(ids)
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class WordBpe:
    """Ids of a tokenizers file whose pre-tokeniser drops white space; words are encoded once and looked up."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(text)
        self.model = self.whole.model
        added = json.loads(text)["added_tokens"]
        # Tokens that the library takes out of the text as it stands, before it normalises; of several at one place the longest.
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.apart = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        self.table = {b: ord(c) for b, c in enumerate(byte_table())}
        self.cache = PieceCache(self.encode_piece)
        self.words = WordTable(self.encode_match, lambda word: self.cache.encode([word]))

    def encode_match(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(piece)]

    def encode_piece(self, piece: str) -> list[int]:
        if _MATCH.fullmatch(piece):
            return self.encode_match(piece)
        return self.whole.encode(piece, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """Parts that can be encoded apart: added tokens, and of what lies between them matches, or what lies between ASCII white space."""
        if not self.apart:
            return [text]
        if self.added and self.added.search(text):
            out = []
            for k, part in enumerate(self.added.split(text)):
                out += [part] if k % 2 else self.plain_pieces(part)
            return out
        return self.plain_pieces(text)

    @staticmethod
    def plain_pieces(text: str) -> list[str]:
        if _PLAIN.match(text):
            return _MATCH.findall(text.lower())
        out = []
        for p in re.split(r"[ \t-\r]+", text):
            if _PLAIN.match(p):
                out += _MATCH.findall(p.lower())
            elif p:
                out.append(p)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.apart and bool(_PLAIN.match(t)) and not (self.added and self.added.search(t)) for t in texts]
        found = iter(self.words.encode([t.lower() for t, p in zip(texts, plain) if p]))
        return [next(found) if p else self.cache.encode(self.pieces(t)) for t, p in zip(texts, plain)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_coders: dict[int, WordBpe] = {}


def coder(text: str) -> WordBpe:
    key = hash(text)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordBpe(text)
    return _coders[key]


def cuts(n: int, capacity: int, min_cut: int) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    size = capacity // 2
    while size >= min_cut:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] if rest else out


class Filler:
    """Open sequences of each class, held until they have their fixed number of pieces."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Places of (document, start, ids, tokens) pieces in a new sequence."""
        offset, self.next_id = 0, self.next_id + 1
        for doc, start, ids, tokens in pieces:
            yield doc, start, ids, tokens, self.next_id - 1, offset
            offset += len(ids)

    def put(self, piece: tuple) -> Iterator[tuple]:
        j = self.capacity // len(piece[2])
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            yield from self.close(self.open.pop(j))

    def finish(self) -> Iterator[tuple]:
        """What is open, end to end; the last, partial sequence as sequences of powers of two."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        total = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        last = total % self.capacity
        sizes += [1 << b for b in range(last.bit_length() - 1, -1, -1) if last >> b & 1]
        i = 0
        for size in sizes:
            taken = []
            while size:
                doc, start, ids, tokens = rest[i]
                taken.append((doc, start, ids[:size], tokens))
                if len(ids) > size:
                    rest[i] = (doc, start + size, ids[size:], tokens)
                else:
                    i += 1
                size -= len(taken[-1][2])
            yield from self.close(taken)


def pack_documents(
    df: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    min_cut: int = MIN_CUT,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Places of all pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are those of the library's encode(text, add_special_tokens=False): names
    of the file's special tokens in a text are those tokens. Null and empty texts
    are their end id alone. Repeated rows are packed as often as they occur. capacity has to be a power of two. A sequence's rows
    are gapless from offset 0; sequence ids are unique, not dense.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, filler = coder(shared.value), Filler(capacity, TaskContext.get().partitionId() << 33)
        id_type = pa.int64()

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, tokens, sequence, offset = zip(*placed)
            arrays = {
                id_col: pa.array(doc, id_type),
                "start": start,
                "length": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "doc_tokens": tokens,
                "sequence_id": sequence,
                "offset": offset,
            }
            if with_ids:
                arrays["ids"] = lists([x.view(np.int32) for x in ids], pa.int32())
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in arrays.values()], names=list(arrays))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for docs, texts in batch_slices(batch):
                placed = []
                for doc, ids in zip(docs, bpe.encode_all(texts)):
                    # A copy: what the filler holds must not keep the ids of the whole slice.
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at = 0
                    for n in cuts(len(ids), capacity, min_cut):
                        placed += filler.put((doc, at, ids[at : at + n], len(ids)))
                        at += n
                if placed:
                    yield rows(placed)
        if placed := list(filler.finish()):
            yield rows(placed)

    source = df.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    return source.mapInArrow(run, schema)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
