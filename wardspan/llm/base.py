"""Shared pieces of the text operators: Arrow batches in tasks, and lineage cuts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.operators.cuts import cut, join_summary, release  # noqa: F401

#: Rows and characters of text that one call of a batch function gets at most.
SLICE_ROWS = 256
SLICE_CHARS = 1 << 20
#: Bytes of an Arrow batch that bounded_batches() asks for, and the setting.
BATCH_BYTES = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, or one row; a smaller setting stays.

    Spark's own limit of 64 MB is for narrow rows: a batch of whole texts is held
    several times over, by the JVM and by the worker, for each running task.
    """
    now = spark.conf.get(BATCH_SETTING, None)
    units = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", (now or "64m").strip().lower()).groups()
    if int(number) * units[unit] > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def slices(ids: list, texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows under SLICE_ROWS and ``chars``; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= SLICE_ROWS or size + len(text) > chars):
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def batch_slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The slices of a batch of ids and texts, of which SLICE_ROWS rows at a time are Python objects."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        yield from slices(part.column(0).to_pylist(), part.column(1).to_pylist())


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict]],
    columns: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One output row per input row: the id, and what a batch function returns.

    ``make`` is called once in each task and gives the batch function, which
    takes texts (null as empty) and returns a list or array for each name in
    ``columns`` (DDL, without the id). Other columns of ``df`` are not read, so
    their names can't clash.
    """
    source = df.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for ids, texts in batch_slices(batch):
                found = call(texts)
                arrays = [pa.array(ids, type=batch.schema.field(0).type), *(x if isinstance(x, pa.Array) else pa.array(x) for x in found.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *found])

    return source.mapInArrow(run, schema)


def explode_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list, list[str]], dict]],
    columns: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Any number of output rows: the batch function takes ids and texts and returns all columns."""
    source = df.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for ids, texts in batch_slices(batch):
                found = call(ids, texts)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()], names=list(found))

    return source.mapInArrow(run, columns)


def free_name(df: DataFrame) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, "own_"
    while name in taken:
        name += "_"
    return name


def by_ids(df: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """df semi- or anti-joined with the only column of ids, null meeting null; whatever df's columns are called."""
    name = free_name(df)
    return df.join(ids.select(F.col(ids.columns[0]).alias(name)), F.col(id_col).eqNullSafe(F.col(name)), how)
