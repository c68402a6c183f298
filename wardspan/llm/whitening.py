"""Operator 12: embeddings whitened on their principal components.

Each task takes count, mean and centred scatter of its blocks, which Chan's
formula merges, in the task and then pairwise up a tree of tasks; only the merged
figures reach the driver, which takes the eigenvectors. A second pass whitens the
fitted vectors and takes their covariance in the same way: it has to be the
identity.

Vectors of another length are a table of their own, fitted by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import cut, release

#: Entries are stored as whole numbers of this part of one.
SCALE = 256
COMPONENTS = 4
#: Rows of a block whose scatter is taken at once.
BLOCK = 4096
#: Entries that all scatter matrices of a table may have, 1 GiB; 11,585 dimensions of one length.
MATRIX_ENTRIES = 1 << 27
#: A component with a smaller part of the variance has none.
NO_VARIANCE = 1e-13
#: Numbers under this one are exact in 64 bits whatever is added to them once.
SAFE = float(1 << 61)


def scaled(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and x, whole numbers floor(256 c); vectors that are null or hold a null or a number that is not finite, or not a long when scaled, go."""
    vector = F.col(vec_col)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(1 << 62))
    doubles = F.transform(vector, lambda c: c.cast("double"))
    good = F.coalesce(F.forall(doubles, fits), F.lit(False))
    return df.filter(good).select(F.col(id_col).alias("id"), F.transform(doubles, lambda c: F.floor(c * SCALE)).alias("x"))


@dataclass
class Figures:
    """Count, exact sums (Python numbers), mean and centred scatter of vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def figures(x: np.ndarray) -> Figures:
    """Of the rows of a block."""
    if x.dtype == np.int64:  # sums of halves, which can't pass 64 bits
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        sums = [(int(a) << 32) + int(b) for a, b in zip(high, low)]
    else:
        sums = [0] * x.shape[1]
    x = x.astype(np.float64)
    mean = x.mean(axis=0)
    x -= mean
    return Figures(len(x), sums, mean, x.T @ x)


def merged(a: Figures, b: Figures) -> Figures:
    n = a.n + b.n
    step = b.mean - a.mean
    return Figures(n, [s + t for s, t in zip(a.sums, b.sums)], a.mean + step * (b.n / n), a.scatter + b.scatter + np.outer(step, step) * (a.n * b.n / n))


def merge_all(a: dict[int, Figures], b: dict[int, Figures]) -> dict[int, Figures]:
    """Figures by length of the vectors."""
    out = dict(a)
    for d, f in b.items():
        out[d] = merged(out[d], f) if d in out else f
    if sum(d * d for d in out) > MATRIX_ENTRIES:
        raise ValueError(f"the covariances of vectors of {len(out)} lengths have more than {MATRIX_ENTRIES} entries")
    return out


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows (a matrix) of a batch's vectors of each length over 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ends, values = np.cumsum(lengths), column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[(ends[rows] - d)[:, None] + np.arange(d)]


def total(vectors: DataFrame, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[int, Figures]:
    """Figures of a column of vectors, each matrix of rows changed first, by length of what is there before the change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, Figures] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                for i in range(0, len(x), BLOCK):
                    told = merge_all(told, {x.shape[1]: figures(change(x[i : i + BLOCK]))})
        rows = [{"d": d, "n": f.n, "sums": [str(s) for s in f.sums], "mean": f.mean.tobytes(), "scatter": f.scatter.tobytes()} for d, f in told.items()]
        yield from pa.Table.from_pylist(rows, schema).to_batches()

    def read(r) -> dict[int, Figures]:
        mean = np.frombuffer(r["mean"])
        return {r["d"]: Figures(r["n"], [int(s) for s in r["sums"]], mean, np.frombuffer(r["scatter"]).reshape(len(mean), len(mean)))}

    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())])
    parts = vectors.mapInArrow(run, "d int, n long, sums array<string>, mean binary, scatter binary").rdd.map(read)
    return parts.treeAggregate({}, merge_all, merge_all)


@dataclass
class Whitening:
    """What turns vectors of one length into components: x less centre, times basis (a column for each), which holds 1 / sqrt(eigenvalue)."""

    n: int
    sums: list[int]
    centre: np.ndarray
    basis: np.ndarray
    explained: np.ndarray


def whitening(f: Figures, components: int) -> Whitening:
    """The first components by falling eigenvalue, each with its largest entry (of several the first) above 0; without variance a component is 0 everywhere."""
    values, vectors = np.linalg.eigh(f.scatter / f.n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    trace = np.trace(f.scatter) / f.n
    has = values > NO_VARIANCE * trace
    basis = np.where(has, vectors * np.sign(top) / np.sqrt(np.where(has, values, 1.0)), 0.0)
    return Whitening(f.n, f.sums, np.array([s / f.n for s in f.sums]), basis, np.where(has, values / (trace or 1.0), 0.0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Whitening], float]:
    """Whitenings by length of the column's vectors, each taken once, and the largest entry by which a covariance of what they make differs from the identity."""
    distinct = cut(vectors.distinct())
    models = {d: whitening(f, components) for d, f in total(distinct).items()}
    error = 0.0
    for d, f in total(distinct, lambda x: (x - models[x.shape[1]].centre) @ models[x.shape[1]].basis).items():
        has = models[d].explained > 0
        error = max(error, float(np.abs(f.scatter / f.n - np.diag(has.astype(float))).max()))
    release(distinct)
    return models, error


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - sum) squared; None past 64 bits."""
    top = max(float(np.abs(x).max()) * n, max(abs(float(s)) for s in sums))
    if top < SAFE and len(sums) * (2 * top) ** 2 < SAFE:
        off = x * n - np.array(sums)
        return (off * off).sum(axis=1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component up to ``components``: id, component, n, deviation, whitened, explained, identity_error.

    Unusable vectors (null, or with an entry that is null, not finite, or not a
    long when scaled) have none, and neither do empty ones. Vectors of another
    length are whitened among themselves; identity_error is the largest of all.
    Repeated rows have their rows each, but count once in the fit. A component
    without variance, as of a single vector, is 0 with 0 explained, and the
    identity leaves it out. deviation is null where it passes 64 bits. An empty
    table gives no rows. Other columns aren't read.
    """
    rows = scaled(df, id_col, vec_col)
    models, error = fit(rows.select("x"), components)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in by_length(batch.column(1)):
                m = models[x.shape[1]]
                k = m.basis.shape[1]
                each = np.repeat(places, k)
                made = (x - m.centre) @ m.basis
                off = pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)), off, pa.array(made.ravel()),
                        pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(each), error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
