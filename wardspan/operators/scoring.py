"""Scores, thresholds, peers and attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.operators import ranges
from wardspan.operators.cuts import cut, join_summary

# Weights and caps of the live rule, and weights of the batch rule.
LIVE_RULE = {
    "usb_events": (0.25, 20), "files_accessed": (0.20, 200), "has_usb": (0.15, 1), "n_archive_files": (0.10, 10),
    "external_emails": (0.10, 30), "suspicious_http": (0.10, 5), "n_job_site": (0.10, 5),
}
BATCH_RULE = {
    "usb_events_max": 0.25, "files_accessed_max": 0.20, "has_usb_sum": 0.15, "n_archive_files_max": 0.10, "external_emails_max": 0.10,
    "suspicious_http_max": 0.10, "n_job_site_sum": 0.10,
}


def live_rule(rule: dict[str, tuple[float, int]] = LIVE_RULE) -> Column:
    """Weights times capped totals over caps, rounded to four places."""
    return F.round(sum((F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(cap)) * F.lit(w) / F.lit(cap) for c, (w, cap) in rule.items()), F.lit(0.0)), 4)


def with_totals(df: DataFrame, totals: list[Column]) -> DataFrame:
    """df with aggregates over all rows; df is cut, so it is made once; one row is broadcast, whatever the size of df."""
    df = cut(df)
    return df.crossJoin(F.broadcast(df.agg(*totals)))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - least) / (most - least); 0 where all are equal."""
    scaled = with_totals(df, [F.min(column).alias("lo_"), F.max(column).alias("hi_")])
    return scaled.withColumn(out, F.when(F.col("hi_") > F.col("lo_"), (F.col(column) - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).otherwise(0.0)).drop("lo_", "hi_")


def batch_rule(df: DataFrame, rule: dict[str, float] = BATCH_RULE, out: str = "rule_score") -> DataFrame:
    """Each feature over its maximum, weighted and summed, then min-max scaled."""
    df = cut(df)
    tops = df.crossJoin(F.broadcast(df.agg(*[F.max(c).alias(f"{c}_top_") for c in rule])))
    raw = sum((F.when(F.col(f"{c}_top_") > 0, F.lit(w) * F.col(c) / F.col(f"{c}_top_")).otherwise(0.0) for c, w in rule.items()), F.lit(0.0))
    return min_max(tops.withColumn("raw_", raw).drop(*[f"{c}_top_" for c in rule]), "raw_", out).drop("raw_")


def weighted_average(df: DataFrame, forest: str, encoder: str, out: str = "wa_score") -> DataFrame:
    return min_max(df.withColumn("raw_", 0.25 * F.col(forest) + 0.75 * F.col(encoder)), "raw_", out).drop("raw_")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, as c_z; a deviation of 0 counts as 1."""
    totals = with_totals(df, [f(c).alias(f"{c}_{n}_") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    spread = lambda c: F.when(F.col(f"{c}_s_") == 0, 1.0).otherwise(F.col(f"{c}_s_"))
    return totals.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_m_")) / spread(c) for c in columns}).drop(*[f"{c}_{n}_" for c in columns for n in "ms"])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / quartile range by exact percentiles, as c_r; a range of 0 counts as 1. A column without values has none."""
    df = cut(df)
    told = ranges.quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumns({f"{c}_r": (F.col(c) - lit(b)) / lit(1.0 if a == z else z - a if a is not None else None) for c, (a, b, z) in told.items()})


def peer_means(df: DataFrame, columns: list[str], group: str = "peer_group", normal: Column | None = None) -> DataFrame:
    """Means of each group, over normal members only where told, and the size of the group."""
    of = lambda c: F.avg(c if normal is None else F.when(normal, F.col(c)))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("peer_size"), *[of(c).alias(f"{c}_peer_mean") for c in columns])


def peer_ratios(df: DataFrame, columns: list[str], group: str = "peer_group", normal: Column | None = None) -> DataFrame:
    """Value over the group's mean (1 at least), from a join with the groups' few rows."""
    means = peer_means(df, columns, group, normal)
    return df.join(means, group).withColumns({f"{c}_peer_ratio": F.col(c) / F.greatest(F.coalesce(F.col(f"{c}_peer_mean"), F.lit(0.0)), F.lit(1.0)) for c in columns})


def means_of_peers(df: DataFrame, columns: list[str], key: str = "user", group: str = "peer_group") -> DataFrame:
    """key, and the mean of each column over the key's group, under the column's name; rows without a group are left out."""
    known = df.filter(F.col(group).isNotNull())
    means = peer_means(known, columns, group).select(group, *[F.col(f"{c}_peer_mean").alias(c) for c in columns])
    return join_summary(known.select(key, group), means, [group]).select(key, *columns)


def peer_context(df: DataFrame, columns: list[str], role: list[str], key: str = "user", n: int = 8) -> DataFrame:
    """What is told of a user's peers: peer_group, peer_size, deviations (an array of the n farthest: feature, user_value, peer_mean, ratio) and role_means, a structure of the peers' means of the role columns. df has peer_ratios()."""
    top = peer_deviations(df, columns, key, n)
    each = F.array_sort(F.collect_list(F.struct("place", "feature", "user_value", "peer_mean", "ratio")))
    told = top.groupBy(key).agg(F.transform(each, lambda d: d.dropFields("place")).alias("deviations"))
    means = df.select(key, "peer_group", "peer_size", F.struct(*[F.col(f"{c}_peer_mean").alias(c) for c in role]).alias("role_means"))
    return join_summary(means, told, [key]).select(key, "peer_group", "peer_size", "deviations", "role_means")


def long_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, feature, value) of each column."""
    return df.unpivot(key, [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")


def top_by(df: DataFrame, key: str, order: list[Column], n: int, out: str = "place") -> DataFrame:
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn(out, place).filter(F.col(out) <= n)


def top_attribution(long: DataFrame, key: str = "user", n: int = 10) -> DataFrame:
    """A key's n features of largest absolute value."""
    return top_by(long, key, [F.desc(F.abs("value")), F.col("feature")], n)


def peer_deviations(df: DataFrame, columns: list[str], key: str = "user", n: int = 8) -> DataFrame:
    """A user's n features whose rounded ratio to the peers is farthest from 1; df has peer_ratios()."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 2).alias("user_value"), F.round(f"{c}_peer_mean", 2).alias("peer_mean"), F.round(f"{c}_peer_ratio", 3).alias("ratio")) for c in columns]))
    flat = df.select(key, "peer_group", "peer_size", rows.alias("f")).select(key, "peer_group", "peer_size", "f.*")
    return top_by(flat, key, [F.desc(F.abs(F.col("ratio") - 1)), F.col("feature")], n)


def residual_attribution(residuals: Column, score: Column) -> Column:
    """Signed squares, scaled so that the largest is the score (0.001 at least)."""
    squares = F.transform(residuals, lambda d: F.signum(d) * d * d)
    most = F.array_max(F.transform(squares, F.abs))
    return F.when(most > 0, F.transform(squares, lambda v: v / most * F.greatest(score, F.lit(1e-3)))).otherwise(squares)


def mean_square(residuals: Column) -> Column:
    return F.aggregate(residuals, F.lit(0.0), lambda t, d: t + d * d) / F.size(residuals)


def fallback_thresholds(df: DataFrame, score: str) -> DataFrame:
    """high and medium without labels: mean plus 3 and 2 population deviations, 1 at most."""
    high, medium = (F.least(F.avg(score) + k * F.stddev_pop(score), F.lit(1.0)) for k in (3.0, 2.0))
    return df.agg(high.alias("high"), medium.alias("medium")).withColumn("medium", F.least("medium", F.col("high") - 1e-6))
