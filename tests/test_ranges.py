import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspan.operators import evaluate, ranges


@pytest.fixture
def twenty(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_quantiles_like_percentile(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.random(), rng.choice([1, 1, 1, 2, 7]), None if i % 3 else i, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b int, c long, d double").repartition(20)
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "abc"]).first()
    for opened in (100_000, 300):  # the second splits ranges again and again
        monkeypatch.setattr(ranges, "OPENED", opened)
        got = ranges.quantiles(df, {c: shares for c in "abcd"})
        assert got["d"] == [None] * 7
        for c in "abc":
            assert got[c] == pytest.approx(want[c], abs=1e-12), c
    assert ranges.quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_only_the_range_of_a_rank_is_opened(spark, monkeypatch):
    """All values distinct, 20 partitions: what reaches the driver is one small part of them."""
    monkeypatch.setattr(ranges, "OPENED", 200)
    seen = []
    split = ranges._split
    monkeypatch.setattr(ranges, "_split", lambda counts, r: seen.append(parts := split(counts, r)) or parts)
    df = spark.range(20_000).repartition(20).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    n, values = ranges.at_ranks(df, {"v": lambda n: [n // 2]})["v"]
    assert (n, values) == (20_000, {10_000: 10_000.0})
    assert len(seen) == 2 and all(len(parts) == 1 for parts in seen) and seen[0][0].distinct < 1000 and seen[-1][0].distinct <= 200


def test_not_a_number_is_largest(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    n, values = ranges.at_ranks(df, {"v": lambda n: [0, 1, 2]})["v"]
    assert n == 3 and values[0] == 1.0 and values[1] == 2.0 and np.isnan(values[2])


def test_running_sums_of_twenty_ranges(spark, twenty):
    n = 4000
    df = spark.range(n).repartition(20).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") % 5).alias("w"))
    out = ranges.running(df, [F.desc("v")], ["w"])
    assert out.columns == ["v", "w", "w_upto", "w_all"]
    rows = sorted(out.collect(), key=lambda r: -r["v"])
    total = 0
    for r in rows:
        total += r["w"]
        assert (r["w_upto"], r["w_all"]) == (total, 8000)
    # A task of the windows holds a range, not all rows.
    dealt = df.repartitionByRange(20, F.desc("v")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < n / 8
    assert ranges.running(df.limit(0), [F.col("v")], ["w"]).count() == 0


def test_ranks(spark, twenty):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 1, 5, None, 2, 5, 1])], "i int, v int")
    got = {r["i"]: r["share"] for r in ranges.rank_share(df, "v", "share").collect()}
    assert got == {0: 5 / 6, 1: 1.5 / 6, 2: 5 / 6, 3: None, 4: 3 / 6, 5: 5 / 6, 6: 1.5 / 6}
    placed = ranges.numbered(spark.range(100).select((99 - F.col("id")).alias("k")), [F.col("k")], "place").collect()
    assert all(r["place"] == r["k"] + 1 for r in placed)


def test_curves_tell_scores_apart_that_rounding_would_not(spark, twenty):
    df = spark.createDataFrame([(0.1, 0), (0.1 + 1e-9, 1), (0.1 + 2e-9, 0), (0.1 + 3e-9, 1)], "score double, label int")
    assert evaluate.curve(df).count() == 4 and evaluate.curve(df, places=6).count() == 1
    assert evaluate.auroc(df).first()["auroc"] == 0.75 and evaluate.auroc(df, places=6).first()["auroc"] == 0.5
    values = [random.Random(2).random() * 1e-8 for _ in range(101)]
    got = evaluate.latency(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (got["p50"], got["p95"], got["p99"]) == tuple(sorted(values)[k] for k in (50, 95, 99)) and abs(got["mean"] - statistics.fmean(values)) < 1e-18
