"""Order statistics, ranks and running sums over all rows without one task for all of them.

Ranks are found by counting: values are counted once each, the range that holds
the wanted rank is split again and again, and only what is left of it is opened.
Running sums deal rows out by ranges of their order; a range adds up by itself,
and the sums of the ranges before it, a row for each range, come on top.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.operators.cuts import cut, join_summary, release

#: Distinct values that are looked at in one place, over all ranges, and parts that a larger range is split into.
OPENED, PARTS = 100_000, 64


@dataclass
class Range:
    """Values of a column over ``low`` and up to ``high`` (None: no bound), with how many rows lie below, the wanted ranks and the distinct values inside."""

    column: str
    low: float | None
    high: float | None
    before: int
    wanted: list[int]
    distinct: int

    def holds(self) -> Column:
        inside = F.col("c") == self.column
        if self.low is not None:
            inside &= F.col("v") > self.low
        return inside if self.high is None else inside & (F.col("v") <= self.high)


def _split(counts: DataFrame, r: Range) -> list[Range]:
    """The parts of a range that hold a wanted rank."""
    inside = counts.filter(r.holds())
    marks = sorted(set(inside.approxQuantile("v", [i / PARTS for i in range(1, PARTS)], 1 / (4 * PARTS))))
    part = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col("v")))
    sums = {row["part"]: row for row in inside.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    out, before = [], r.before
    for i, (low, high) in enumerate(zip([r.low, *marks], [*marks, r.high])):
        n = sums[i]["n"] if i in sums else 0
        if wanted := [k for k in r.wanted if before <= k < before + n]:
            out.append(Range(r.column, low, high, before, wanted, sums[i]["d"]))
        before += n
    return out


def at_ranks(df: DataFrame, ranks: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column how many values it has, and those at the ranks (from 0) that a function of that number asks for.

    Nulls don't count; NaN lies over all numbers. Equal values are counted before
    they are dealt out, so a frequent one is a single row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ranks]))
    counts = cut(df.select(each.alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["c"]: r for r in counts.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    out: dict[str, tuple[int, dict[int, float]]] = {c: (sizes[c]["n"] if c in sizes else 0, {}) for c in ranks}
    open_ = [Range(c, None, None, 0, sorted(set(ranks[c](n))), sizes[c]["d"]) for c, (n, _) in out.items() if n]
    most = max(PARTS, OPENED // max(1, len(open_)))
    while large := [r for r in open_ if r.distinct > most]:
        open_ = [r for r in open_ if r.distinct <= most] + [part for r in large for part in _split(counts, r)]
    rows = counts.filter(reduce(lambda a, b: a | b, [r.holds() for r in open_])).collect() if open_ else []
    for r in open_:
        inside = [(x["v"], x["n"]) for x in rows if x["c"] == r.column and (r.low is None or above(x["v"], r.low)) and (r.high is None or not above(x["v"], r.high))]
        k = r.before
        for v, n in sorted(inside, key=lambda x: (math.isnan(x[0]), x[0])):
            out[r.column][1].update({w: v for w in r.wanted if k <= w < k + n})
            k += n
    release(counts)
    return out


def above(a: float, b: float) -> bool:
    return a > b or math.isnan(a) and not math.isnan(b)


def quantiles(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, between two values in proportion to their distance, as ``percentile`` has them; None for a column without values."""
    places = lambda q, n: (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))
    found = at_ranks(df, {c: lambda n, qs=qs: [k for q in qs for k in places(q, n)] for c, qs in shares.items()})

    def between(n: int, values: dict[int, float], q: float) -> float | None:
        if not n:
            return None
        (low, high), at = places(q, n), q * (n - 1)
        return values[low] if values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]

    return {c: [between(*found[c], q) for q in qs] for c, qs in shares.items()}


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with c_upto, the sum of c over the rows up to each in an order that tells all rows apart, and c_all, that over all rows.

    Rows are dealt out by ranges of the order and cut, so that each keeps its
    place. Nulls count as 0.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(ranges, *order).withColumn("part_", F.spark_partition_id()))
    parts = sorted(dealt.groupBy("part_").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).collect(), key=lambda r: r["part_"])
    before, rows = [0] * len(sums), []
    for r in parts:
        rows.append((r["part_"], *before))
        before = [b + r[c] for b, c in zip(before, sums)]
    kinds = [dealt.agg(F.sum(c)).schema[0].dataType.simpleString() for c in sums]
    offsets = spark.createDataFrame(rows, "part_ int, " + ", ".join(f"`{c}_before_` {k}" for c, k in zip(sums, kinds)))
    upto = W.partitionBy("part_").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = dealt.withColumns({f"{c}_upto": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums})
    told = own.join(F.broadcast(offsets), "part_")
    return told.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"{c}_before_") for c in sums} | {f"{c}_all": F.lit(b).cast(k) for c, b, k in zip(sums, before, kinds)}).select(
        *df.columns, *[f"{c}_upto" for c in sums], *[f"{c}_all" for c in sums]
    )


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Every row's number from 1, in an order that tells all rows apart."""
    return running(df.withColumn("one_", F.lit(1).cast("long")), order, ["one_"]).withColumn(out, F.col("one__upto")).drop("one_", "one__upto", "one__all")


def rank_share(df: DataFrame, column: str, out: str) -> DataFrame:
    """The average rank of each value over the number of rows, equal values alike; ranks are those of counts per value. Nulls have none, and don't count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_"))
    told = running(counts, [F.col(column)], ["n_"])
    share = (F.col("n__upto") - F.col("n_") + 1 + (F.col("n_") - 1) / 2) / F.col("n__all")
    return join_summary(df, told.select(column, share.alias(out)), [column], "left")
