import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wardspan.llm import matroska as M


@given(st.binary(max_size=70_000), st.sampled_from([64, 512, 777]))
def test_round_trip(payload, frame):
    data = M.mux(payload, frame)
    media = M.parse(data)
    assert M.read_payload(data, media) == payload
    assert sum(p.size for p in media.packets) == len(payload)
    starts = [p.timestamp for p in media.packets]
    assert starts == sorted(starts) and {c[2] for c in media.cues} == {p.cluster for p in media.packets}


@pytest.mark.parametrize("lacing, sizes", [(0, [5]), (1, [300, 255, 1000, 0, 3]), (2, [40, 40, 40]), (3, [300, 255, 1000, 0, 3]), (3, [1, 40_000, 2])])
def test_lacing(lacing, sizes):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    data = M.block(1, 7, frames, lacing)
    _, _, start, end = next(M.elements(data, 0, len(data)))
    assert [data[a : a + n] for a, n in M.laces(data, start + 4, end, lacing)] == frames


def test_unknown_size_cluster_and_groups():
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska"))
    block = M.block(1, 2, [b"abc"])
    grouped = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block[2:]))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.number(M.TIMESTAMP, 100) + block + grouped
    data = head + M.element(M.SEGMENT, cluster + M.element(M.CUES, b""))
    assert [(p.timestamp, p.size) for p in M.parse(data).packets] == [(102, 3), (102, 3)]


def test_rows(spark):
    df = spark.createDataFrame([(1, "héllo", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, media string")
    stored = M.store_texts(df)
    rows = {r["doc_id"]: r for r in M.read_media(stored).collect()}
    assert bytes(rows[1]["payload"]) == "héllo".encode() + bytes(64 - 6)
    assert bytes(rows[2]["payload"]) == bytes(64) == bytes(rows[3]["payload"])
    table = M.packet_table(stored.filter("doc_id = 1")).collect()
    assert [(r["track"], r["timestamp"], r["byte_size"]) for r in table] == [(1, 0, 64)]
    assert M.packet_table(stored.limit(0)).count() == 0


def test_broken_media(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(M.mux(b"x" * 200)[:120]))], "doc_id long, media binary")
    assert {r["payload"] for r in M.read_media(df).collect()} == {None}
    assert M.packet_table(df).count() == 0


def test_query_against_a_plain_computation(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in M.op2_matroska(spark, small).collect():
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > r["payload_bytes"]
