import math

import numpy as np

from wardspan.llm import whitening


def plain(vectors, k=4):
    """n, sums, eigenvalues and eigenvectors of distinct scaled vectors, all of one length, by exact sums."""
    xs = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    cov = np.array([[sum(n * x[i] * x[j] for x in xs) - sums[i] * sums[j] for j in range(d)] for i in range(d)], dtype=object)
    values, basis = np.linalg.eigh((cov / n / n).astype(float))
    return n, sums, values[::-1], basis[:, ::-1], sum(cov[i, i] for i in range(d)) / n / n


def check(rows, vectors):
    """Rows by id against the plain computation; signs are free but the same in all rows."""
    n, sums, values, basis, trace = plain(vectors.values())
    k = min(4, len(sums))
    assert len(rows) == k * len(vectors)
    signs = {}
    for r in rows:
        x = [math.floor(256 * float(c)) for c in vectors[r["vec_id"]]]
        j = r["component"] - 1
        want = sum((c - s / n) * b for c, s, b in zip(x, sums, basis[:, j])) / math.sqrt(values[j])
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert abs(r["explained"] - values[j] / trace) < 1e-9 and r["identity_error"] < 1e-8
        if abs(want) > 1e-6:
            assert signs.setdefault(j, np.sign(r["whitened"] * want)) == np.sign(r["whitened"] * want)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-7


def test_query(spark, small):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    check(whitening.op12_whitening(spark, small).collect(), vectors)


def test_merging_is_the_whole():
    rng = np.random.default_rng(1)
    x = rng.integers(-400, 400, (3000, 6)) + 10**6
    parts = [whitening.figures(p) for p in np.split(x, [1, 2, 700, 2999])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.merged(whole, p)
    assert whole.n == 3000 and whole.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(whole.scatter, np.cov(x.T, bias=True) * 3000, rtol=1e-9, atol=1e-3)


def test_rows(spark):
    rng = np.random.default_rng(2)
    good = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(60)}
    rows = [(i, v, i) for i, v in good.items()] + [(100 + i, good[7], 0) for i in range(40)]
    bad = [(200, None, 1), (201, [None] * 5, 1), (202, [1.0, float("nan"), 1.0, 1.0, 1.0], 1), (203, [float("inf")] * 5, 1), (204, [], 1), (205, [3e38] * 5, None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int").repartition(7)
    check(whitening.whiten(df).collect(), good | {100 + i: good[7] for i in range(40)})
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id >= 200")).count() == 0
    named = whitening.whiten(df.selectExpr("nullif(cast(vec_id AS string), '3') AS vec_id", "embedding")).collect()
    assert len(named) == 400 and {r["vec_id"] for r in named} == {None} | {str(i) for i in [*range(60), *range(100, 140)] if i != 3}


def test_lengths_are_tables_of_their_own(spark):
    rng = np.random.default_rng(3)
    threes = {i: rng.normal(size=3).tolist() for i in range(30)}
    sevens = {100 + i: rng.normal(size=7).tolist() for i in range(50)}
    found = whitening.whiten(spark.createDataFrame([*threes.items(), *sevens.items()], "vec_id long, embedding array<double>")).collect()
    check([r for r in found if r["vec_id"] < 100], threes)
    check([r for r in found if r["vec_id"] >= 100], sevens)


def test_without_variance(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, -0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.001])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows) == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2, 3) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["component"], abs(r["whitened"]), r["explained"]) for r in line) == [(1, 1, 1.0, 1.0), (1, 2, 0.0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 0.0, 0.0)]


def test_deviations_are_exact():
    big = np.array([[10**9, -(10**9)], [3, 4]], dtype=np.int64)
    for n, sums in ((7, [10**9, 5]), (10**6, [10**15, -(10**14)]), (1, [0, 0])):
        want = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in big.tolist()]
        assert whitening.deviations(big, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_too_many_lengths_stop(monkeypatch):
    monkeypatch.setattr(whitening, "MATRIX_ENTRIES", 20)
    f = lambda d: {d: whitening.figures(np.ones((2, d), np.int64))}
    assert sorted(whitening.merge_all(f(2), f(4))) == [2, 4]
    try:
        whitening.merge_all(f(3), f(4))
    except ValueError as e:
        assert "2 lengths" in str(e)
    else:
        raise AssertionError
