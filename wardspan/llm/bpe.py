"""Operator 1: byte-level BPE encoding and decoding.

The merges of a rank file are recovered once on the driver and travel as one
tokenizer file (a few MB, fixed by the vocabulary) to the tasks, where the
tokenizers library encodes Arrow batches. A piece between single spaces is
encoded once per worker and looked up afterwards: no match of the pattern
reaches across the start of a run of white space, so pieces are independent.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.llm.base import documents, map_texts

#: Entries of the cache of pieces in one worker, and the longest piece kept in it.
CACHE_ENTRIES = 1 << 16
CACHE_CHARS = 48

# What the short way below covers: Latin letters of one code point, digits, ASCII punctuation but the
# apostrophe, and ASCII white space. On such texts this pattern matches as the public one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCTUATION = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{LETTERS}0-9{PUNCTUATION} \t-\r]*\Z")
_MATCH = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[{PUNCTUATION}]+|[ \t-\r]+(?![{LETTERS}0-9{PUNCTUATION}])|[ \t-\r]+")
_CUT = re.compile(r"(?<!\s) ")


def byte_table() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that lowest-rank-first merging joins into this token last; None if it never does.

    A token only arises from parts inside its own bytes, and merges inside them
    take the same order in any surroundings, so this pair is the only one.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if rank == 1 << 60:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if parts[0] in ranks and parts[1] in ranks else None


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str, pattern: str) -> str:
    """A tokenizers file with the ranks as vocabulary, the recovered merges and the pattern."""
    ranks, table = read_ranks(path), byte_table()
    name = {token: "".join(table[b] for b in token) for token in ranks}
    pairs = sorted((rank, pair) for token, rank in ranks.items() if len(token) > 1 and (pair := last_pair(token, ranks)))
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": None,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                "ignore_merges": True,
                "vocab": {name[t]: r for t, r in ranks.items()},
                "merges": [[name[a], name[b]] for _, (a, b) in pairs],
            },
        }
    )


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(total)]


class PieceCache:
    """Ids of the pieces of texts, each encoded by ``encode_piece`` when it is missing and kept in one flat array.

    A full cache keeps the half of its entries that most calls met, so that pieces
    met once don't push out frequent ones. It never has more than CACHE_ENTRIES.
    """

    def __init__(self, encode_piece) -> None:
        self.encode_piece = encode_piece
        #: Each piece's number: its place in order of arrival.
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.counts, self.met = (np.zeros(CACHE_ENTRIES, np.int64) for _ in range(3))
        self.used = 0

    def shrink(self) -> None:
        """Keeps the entries met most; what they were met for counts half from now on."""
        n = len(self.at)
        keep = np.sort(np.argpartition(-self.met[:n], CACHE_ENTRIES // 2)[: CACHE_ENTRIES // 2]) if n > CACHE_ENTRIES // 2 else np.arange(n)
        names, m = list(self.at), len(keep)
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        counts = self.counts[keep]
        self.flat = gather(self.flat, self.starts[keep], counts)
        self.used = len(self.flat)
        self.counts[:m], self.starts[:m], self.met[:m] = counts, np.cumsum(counts) - counts, self.met[keep] // 2
        self.met[m:] = 0

    def add(self, pieces: list[str]) -> None:
        found, n = list(map(self.encode_piece, pieces)), len(self.at)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total = int(counts.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used, 1 << 16), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, total)
        self.counts[n : n + len(found)] = counts
        self.starts[n : n + len(found)] = self.used + np.cumsum(counts) - counts
        self.at.update(zip(pieces, range(n, n + len(found))))
        self.used += total

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def short(self, pieces: list[str]) -> np.ndarray:
        """Ids of at most half of CACHE_ENTRIES pieces."""
        which = self.numbers(pieces)
        missing = np.flatnonzero(which < 0).tolist()
        new = list(dict.fromkeys(map(pieces.__getitem__, missing)))
        if new and max(map(len, new)) > CACHE_CHARS:
            return self.mixed(pieces)
        if len(self.at) + len(new) > CACHE_ENTRIES:
            self.shrink()
            return self.short(pieces)
        if new:
            self.add(new)
            which[missing] = self.numbers(list(map(pieces.__getitem__, missing)))
        self.met[which] += 1
        return gather(self.flat, self.starts[which], self.counts[which])

    def mixed(self, pieces: list[str]) -> np.ndarray:
        """The same with pieces over CACHE_CHARS, which aren't kept."""
        out, run = [], []
        for p in pieces:
            if len(p) <= CACHE_CHARS:
                run.append(p)
                continue
            if run:
                out.append(self.short(run))
                run = []
            out.append(np.array(self.encode_piece(p), np.uint32))
        return np.concatenate([*out, self.short(run)] if run else out)

    def encode(self, pieces: list[str]) -> np.ndarray:
        """Ids of all pieces in order."""
        step = CACHE_ENTRIES // 2
        if len(pieces) <= step:
            return self.short(pieces)
        return np.concatenate([self.short(pieces[i : i + step]) for i in range(0, len(pieces), step)])


class ByteBpe:
    """Encodes and decodes with one byte-level vocabulary."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(text)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.table = {b: ord(c) for b, c in enumerate(byte_table())}
        back = {c: b for b, c in self.table.items()}
        vocab = self.whole.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            tokens[i] = bytes(back[ord(c)] for c in name)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache = PieceCache(self.encode_piece)

    def encode_piece(self, piece: str) -> list[int]:
        if _MATCH.fullmatch(piece):
            return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]
        return self.whole.encode(piece, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """Parts that can be encoded apart: matches, or what lies between starts of white space."""
        if _PLAIN.match(text):
            return _MATCH.findall(text)
        first, *rest = _CUT.split(text)
        out = [first] if first else []
        for p in rest:
            out += _MATCH.findall(" " + p) if _PLAIN.match(p) else [" " + p]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.cache.encode(self.pieces(text))

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return gather(self.bytes, self.begins[ids], self.lengths[ids]).tobytes()

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character, and one past the last, of each token; a token inside a character has that character."""
        ends = np.cumsum(self.lengths[ids.astype(np.int64)])
        lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        first = lead[ends - self.lengths[ids.astype(np.int64)]] - 1
        return first, lead[ends - 1]


_coders: dict[int, ByteBpe] = {}


def coder(text: str) -> ByteBpe:
    """One coder for each vocabulary and Python worker."""
    key = hash(text)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(text)
    return _coders[key]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def encode_bpe(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """Token ids of every whole text: id, ids array<int>, and with_offsets also char_start and char_end array<int>.

    Null and empty texts have no ids. Repeated rows stay. Each match of the
    pattern is encoded separately and special tokens are ordinary text.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))

    def make():
        bpe = coder(shared.value)

        def call(texts):
            ids = [bpe.encode(t) for t in texts]
            found = {"ids": lists([a.view(np.int32) for a in ids], pa.int32())}
            if with_offsets:
                spans = [bpe.offsets(a, t.encode()) if len(a) else (a, a) for a, t in zip(ids, texts)]
                found["char_start"] = lists([s.astype(np.int32) for s, _ in spans], pa.int32())
                found["char_end"] = lists([e.astype(np.int32) for _, e in spans], pa.int32())
            return found

        return call

    return map_texts(df, make, "ids array<int>" + ", char_start array<int>, char_end array<int>" * with_offsets, id_col, text_col)


def decode_bpe(path: str, pattern: str, spark: SparkSession, ids_col: str = "ids"):
    """A column of the bytes of token ids; null ids give empty bytes.

    Bytes, as the ids of a cut sequence can end inside a character: decode_text()
    makes text of them, with U+FFFD for each split character.
    """
    shared = spark.sparkContext.broadcast(tokenizer_json(path, pattern))

    @F.arrow_udf(T.BinaryType())
    def decoded(ids: pa.Array) -> pa.Array:
        bpe = coder(shared.value)
        return pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else b"" for x in ids], pa.binary())

    return decoded(F.col(ids_col))


def decode_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode_bpe() and decode_bpe()."""

    @F.arrow_udf(T.StringType())
    def ids_sha256(ids: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest() for x in ids])

    encoded = encode_bpe(df, path, pattern)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_sha256("ids").alias("ids_sha256"),
        F.sha2(decode_bpe(path, pattern, df.sparkSession), 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
