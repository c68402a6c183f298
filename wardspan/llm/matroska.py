"""Operator 2: media columns in Matroska.

A payload of 8-bit samples is stored as one PCM track: EBML header, segment,
clusters of laced blocks, and cues. Reading walks the variable-length elements
and gives a packet table: track, timestamp and byte range of every frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import documents, map_texts

PAD = 64
FRAME = 512
FRAMES_IN_BLOCK = 8
BLOCKS_IN_CLUSTER = 8
RATE = 8000

# Element ids of the public Matroska specification (RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7
EBML_MAX_ID, EBML_MAX_SIZE = 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
LACING, CODEC, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold others.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements that end a cluster of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    size: int
    keyframe: bool
    lacing: int
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    scale: int


def size_vint(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    """A lace's difference of sizes: the shortest width whose bias covers it."""
    width = 1
    while not -((1 << 7 * width - 1) - 1) <= n <= (1 << 7 * width - 1) - 1:
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(data)) + data


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    """A simple block; lacing 0 none, 1 Xiph, 2 fixed, 3 EBML, by default what suits the frames."""
    if lacing is None:
        lacing = 0 if len(frames) == 1 else 2 if len({len(f) for f in frames}) == 1 else 3
    head = size_vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += size_vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A Matroska file of one 8-bit mono track; the same payload always gives the same bytes."""
    header = element(
        EBML,
        number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2),
    )
    info = element(
        INFO,
        number(SCALE, 1_000_000_000 // rate) + element(DURATION, struct.pack(">d", len(payload)))
        + element(MUXER, b"wardspan") + element(WRITER, b"wardspan"),
    )
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio
    head = info + element(TRACKS, element(TRACK, track))
    clusters, points, position = [], [], len(head)
    per_block = frame * FRAMES_IN_BLOCK
    for at in range(0, len(payload), per_block * BLOCKS_IN_CLUSTER):
        end = min(len(payload), at + per_block * BLOCKS_IN_CLUSTER)
        body = [number(TIMESTAMP, at)]
        for b in range(at, end, per_block):
            stop = min(end, b + per_block)
            body.append(block(1, b - at, [payload[i : min(stop, i + frame)] for i in range(b, stop, frame)]))
        clusters.append(element(CLUSTER, b"".join(body)))
        points.append(element(CUE_POINT, number(CUE_TIME, at) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, position))))
        position += len(clusters[-1])
    return header + element(SEGMENT, b"".join([head, *clusters, element(CUES, b"".join(points))]))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value, width and next place of a variable-length integer."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep_marker else n & (1 << 7 * width) - 1), width, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, start and end of the content) of what lies side by side; an unknown size reaches to ``end`` or the next top element."""
    while at < end:
        place = at
        ident, _, at = read_vint(data, at, True)
        size, width, at = read_vint(data, at)
        if size == (1 << 7 * width) - 1:
            stop = end
            if ident == CLUSTER:
                inner = at
                while inner < end:
                    i, _, j = read_vint(data, inner, True)
                    if i in TOP:
                        stop = inner
                        break
                    n, _, j = read_vint(data, j)
                    inner = j + n
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element at {place} ends after its parent")
        yield ident, place, at, stop
        at = stop


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Start and size of each frame of a block."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(at + i * size, size) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            size, width, at = read_vint(data, at)
            if i:
                size = sizes[-1] + size - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def unsigned(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def parse(data: bytes) -> Media:
    """Packets, cues (time, track, place in the segment) and nanoseconds in a tick; ValueError for what isn't Matroska."""
    packets, cues, scale = [], [], 1_000_000
    found = list(elements(data, 0, len(data)))
    if not found or found[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, _, start, end in found:
        if ident != SEGMENT:
            continue
        for top, place, a, b in elements(data, start, end):
            if top == INFO:
                scale = next((unsigned(data, s, e) for i, _, s, e in elements(data, a, b) if i == SCALE), scale)
            elif top == CUES:
                for _, _, s, e in elements(data, a, b):
                    time, spots = 0, []
                    for i, _, x, y in elements(data, s, e):
                        if i == CUE_TIME:
                            time = unsigned(data, x, y)
                        elif i == CUE_POSITIONS:
                            spots.append({j: unsigned(data, p, q) for j, _, p, q in elements(data, x, y)})
                    cues += [(time, spot.get(CUE_TRACK, 0), spot.get(CUE_CLUSTER, 0)) for spot in spots]
            elif top == CLUSTER:
                base = 0
                for i, _, s, e in elements(data, a, b):
                    if i == TIMESTAMP:
                        base = unsigned(data, s, e)
                        continue
                    if i == BLOCK_GROUP:
                        s, e = next(((x, y) for j, _, x, y in elements(data, s, e) if j == BLOCK), (e, e))
                    elif i != SIMPLE_BLOCK:
                        continue
                    if s == e:
                        continue
                    track, _, at = read_vint(data, s)
                    relative, flags = struct.unpack(">hB", data[at : at + 3])
                    kind = flags >> 1 & 3
                    packets += [Packet(track, base + relative, x, n, bool(flags & 0x80), kind, place - start) for x, n in laces(data, at + 3, e, kind)]
    return Media(packets, cues, scale)


def read_payload(data: bytes, media: Media, track: int = 1) -> bytes:
    view = memoryview(data)
    return b"".join(view[p.start : p.start + p.size] for p in media.packets if p.track == track)


def padded(text: str) -> tuple[int, bytes]:
    """Bytes of a text, and the text as bytes up to a positive multiple of PAD."""
    data = text.encode()
    return len(data), data + bytes(-len(data) % PAD or (0 if data else PAD))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (binary, a Matroska file) of every whole text; null is empty."""

    def call(texts):
        made = [padded(t) for t in texts]
        return {"n_bytes": [n for n, _ in made], "media": [mux(p) for _, p in made]}

    return map_texts(df, lambda: call, "n_bytes long, media binary", id_col, text_col)


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, n_packets, n_clusters, n_cues, payload (binary) and feature of stored media.

    Null or broken media give a null payload and feature, and no packets.
    """
    source = df.select(F.col(id_col).alias("id_"), F.col(media_col).alias("media_"))
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, rows = batch.slice(i, 64), []
                for data in part.column(1).to_pylist():
                    try:
                        media = parse(data or b"")
                    except (ValueError, IndexError, struct.error):
                        rows.append((0, 0, 0, None, None))
                        continue
                    payload = read_payload(data, media)
                    clusters = len({p.cluster for p in media.packets})
                    rows.append((len(media.packets), clusters, len(media.cues), payload, feature(media, payload)))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, "n_packets", "n_clusters", "n_cues", "payload", "feature"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_packets long, n_clusters long, n_cues long, payload binary, feature string")


def feature(media: Media, payload: bytes) -> str:
    """Frames, seconds, mean and energy of the samples, and shares of four bands of values."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "frames=0"
    bands = np.bincount(x >> 6, minlength=4) / len(x)
    seconds = len(x) * media.scale / 1e9
    spread = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"frames={len(media.packets)};seconds={seconds:.4f};mean={x.mean():.4f};change={spread:.4f};bands=" + "/".join(f"{b:.4f}" for b in bands)


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per frame: id, track, timestamp, byte_start, byte_size, keyframe, lacing, cluster. Broken media have none."""
    kind = dict(df.dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id_"), F.col(media_col).alias("media_"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    packets = parse(batch.column(1)[i].as_py() or b"").packets
                except (ValueError, IndexError, struct.error):
                    continue
                if packets:
                    columns = [pa.array(c) for c in zip(*packets)]
                    ids = pa.array([batch.column(0)[i].as_py()] * len(packets), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_col, "track", "timestamp", "byte_start", "byte_size", "keyframe", "lacing", "cluster"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, track long, timestamp long, byte_start long, byte_size long, keyframe boolean, lacing long, cluster long")


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(documents(spark, sf_dir))
    source = stored.select(F.struct("doc_id", "n_bytes", F.length("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("key"), "media")
    tail = F.expr(f"crc32(substring(payload, -{PAD}, {PAD}))")
    return read_media(source, "key").select(
        "key.doc_id",
        "key.n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"),
        F.col("key.media_bytes").cast("long").alias("media_bytes"),
        "key.media_sha256",
        "feature",
        "n_packets",
    )
