import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from wardspan.llm import sharding


def plain(sizes, limit):
    """Prefix of each key, by splitting the directory one bit at a time."""
    bits = {k: format(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), "060b") for k in sizes}
    out, todo = {}, [("", list(sizes))]
    while todo:
        prefix, keys = todo.pop()
        if sum(sizes[k] for k in keys) <= limit or len(keys) == 1:
            out |= {k: prefix for k in keys}
            continue
        for b in "01":
            if part := [k for k in keys if bits[k][len(prefix)] == b]:
                todo.append((prefix + b, part))
    return out


def test_like_splitting_bit_by_bit(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"), F.lit(1).alias("shard"))
    sizes = {i: i % 97 for i in range(500)}
    got = {r["doc_id"]: r for r in sharding.extendible_shards(df, limit=1000).collect()}
    expected = plain(sizes, 1000)
    assert {k: r["shard"] for k, r in got.items()} == expected
    assert all(r["shard_bytes"] <= 1000 and r["depth"] == len(r["shard"]) for r in got.values())


def test_hot_key_splits_by_rows(spark):
    df = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 50).alias("text"))
    rows = sharding.extendible_shards(df, limit=1000).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["n_bytes"]
    assert len(rows) == 300 and max(sizes.values()) <= 1000


def test_rows(spark):
    df = spark.createDataFrame([(None, "abc"), (1, None), (2, ""), (3, "y" * 500)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sharding.extendible_shards(df, limit=100).collect()}
    assert len(rows) == 4 and rows[3]["shard_bytes"] == 500 and rows[1]["n_bytes"] == 0
    assert sharding.extendible_shards(df.limit(0), limit=100).count() == 0


def test_a_very_long_text(spark):
    sizes = {i: 300 for i in range(40)} | {40: 3_000_000, 41: 900}
    df = spark.createDataFrame([(i, "z" * n) for i, n in sizes.items()], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sharding.extendible_shards(df, limit=1000).collect()}
    assert {i: r["n_bytes"] for i, r in rows.items()} == sizes
    alone = [i for i, r in rows.items() if r["shard"] == rows[40]["shard"]]
    assert alone == [40] and all(r["shard_bytes"] <= 1000 for i, r in rows.items() if i != 40)
