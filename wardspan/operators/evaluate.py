"""Quality of detectors: curves and figures from scores and labels.

Everything follows from counts per distinct score; running totals and quantiles
go by ranges of scores, so no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.operators import ranges, scoring
from wardspan.operators.cuts import cut


def curve(df: DataFrame, score: str = "score", label: str = "label", places: int | None = None) -> DataFrame:
    """score (falling), p, n, tp, fp, positives, negatives: what lies at each score or above; with places, scores are rounded first."""
    value = F.col(score) if places is None else F.round(F.col(score), places)
    steps = df.groupBy(value.alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    run = ranges.running(steps, [F.desc("score")], ["p", "n"])
    return run.select("score", "p", "n", F.col("p_upto").alias("tp"), (F.col("n_upto") - F.col("p_upto")).alias("fp"), F.col("p_all").alias("positives"), (F.col("n_all") - F.col("p_all")).alias("negatives"))


def precision_recall(df: DataFrame, **kw) -> DataFrame:
    """threshold, precision, recall and f1 at each score."""
    c = curve(df, **kw)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    return c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"), f1.alias("f1"), "tp", "fp", "positives", "negatives")


def roc(df: DataFrame, **kw) -> DataFrame:
    return curve(df, **kw).select(F.col("score").alias("threshold"), F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def auroc(df: DataFrame, **kw) -> DataFrame:
    """The share of pairs of a positive and a negative in the right order, ties as halves."""
    c = curve(df, **kw)
    won = F.sum(F.col("p") * (F.col("negatives") - F.col("fp")) + F.col("p") * (F.col("n") - F.col("p")) / 2)
    return c.agg(F.try_divide(won, F.max(F.col("positives").cast("double")) * F.max("negatives")).alias("auroc"))


def average_precision(df: DataFrame, **kw) -> DataFrame:
    """The sum of precision times the step of recall."""
    c = curve(df, **kw)
    return c.agg(F.sum(F.col("p") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def best_f1(df: DataFrame, **kw) -> DataFrame:
    """The threshold of the largest F1 (of several the lowest), with precision, recall, f1 and n_flagged."""
    pr = precision_recall(df, **kw)
    best = F.max(F.struct(F.round("f1", 12).alias("o"), (-F.col("threshold")).alias("t"), "threshold", "precision", "recall", "f1", (F.col("tp") + F.col("fp")).alias("n_flagged"))).alias("b")
    return pr.agg(best).select("b.threshold", "b.precision", "b.recall", "b.f1", "b.n_flagged")


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    flagged, positive = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(*[F.count_if(c).alias(n) for n, c in (("tp", flagged & positive), ("fp", flagged & ~positive), ("fn", ~flagged & positive), ("tn", ~flagged & ~positive))])


def calibration(df: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Mean score and share of positives in bins between exact quantiles."""
    df = cut(df.select(score, label))
    cuts = F.array(*map(F.lit, ranges.quantiles(df, {score: [i / bins for i in range(1, bins)]})[score]))
    placed = df.withColumn("bin", F.size(F.filter(cuts, lambda c: c < F.col(score))))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))


def flagged_share(df: DataFrame, score: str, label: str, shares: list[float]) -> DataFrame:
    """share, threshold, n_flagged, precision, recall and f1 where each share of all rows with the largest scores is flagged.

    A row is flagged if its score is at the threshold or above, so ties go in
    together. Rows without a score aren't flagged. The share with the largest f1
    is what labels say about contamination; fitting never sees them.
    """
    df = cut(df.select(F.col(score).alias("score_"), F.col(label).cast("long").alias("label_")))
    marks = ranges.quantiles(df, {"score_": [round(1 - s, 12) for s in shares]})["score_"]
    up = [F.col("score_") >= F.lit(m) for m in marks]
    sums = df.agg(F.sum("label_").alias("positives"), *[F.sum(F.when(u, F.col("label_")).otherwise(0)).alias(f"tp{i}") for i, u in enumerate(up)], *[F.count_if(u).alias(f"n{i}") for i, u in enumerate(up)])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(m).cast("double").alias("threshold"), F.col(f"n{i}").alias("n_flagged"), F.col(f"tp{i}").alias("tp")) for i, (s, m) in enumerate(zip(shares, marks))]))
    told = sums.select("positives", each.alias("x")).select("positives", "x.*")
    return told.select("share", "threshold", "n_flagged", F.try_divide("tp", "n_flagged").alias("precision"), F.try_divide("tp", "positives").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("n_flagged") + F.col("positives")).alias("f1"))


def scenario_recall(df: DataFrame, threshold: float, scenario: str = "scenario", score: str = "score") -> DataFrame:
    """Detected and all of each scenario over 0, and its F1 against the normal users (scenario 0)."""
    flagged = F.col(score) >= threshold
    false = df.filter(F.col(scenario) == 0).agg(F.count_if(flagged).alias("fp_"))
    per = df.filter(F.col(scenario) > 0).groupBy(scenario).agg(F.count_if(flagged).alias("detected"), F.count(F.lit(1)).alias("total"))
    return per.crossJoin(F.broadcast(false)).withColumn("f1", 2 * F.col("detected") / (F.col("detected") + F.col("fp_") + F.col("total"))).drop("fp_")


def latency(df: DataFrame, column: str, places: int | None = None) -> DataFrame:
    """Mean, least, most, and the value at index int(n * q) in order for q of .5, .95 and .99; with places, values are rounded first."""
    df = cut(df.select((F.col(column) if places is None else F.round(column, places)).alias("v"), F.col(column).alias("x")))
    n, values = ranges.at_ranks(df, {"v": lambda n: [int(n * q) for q in (0.5, 0.95, 0.99)]})["v"]
    at = lambda q: F.lit(values.get(int(n * q))).cast("double")
    return df.agg(F.avg("x").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def thresholds(df: DataFrame, score: str = "score", label: str = "label", **kw) -> DataFrame:
    """high and medium of a score table: with labels the best F1's threshold and the normal rows' 99th percentile, else scoring.fallback_thresholds(); medium lies below high."""
    if label not in df.columns:
        return scoring.fallback_thresholds(df, score)
    df = cut(df.select(score, label))
    normal = ranges.quantiles(df.filter(F.col(label) == 0), {score: [0.99]})[score][0]
    best = best_f1(df, score=score, label=label, **kw)
    return best.select(F.col("threshold").alias("high"), F.least(F.lit(normal), F.col("threshold") - 1e-6).alias("medium"))


def clipped_histogram(df: DataFrame, column: str, width: float, most: float) -> DataFrame:
    """bin and n: counts of values, cut at ``most``, in bins of a width; null values don't count."""
    value = F.least(F.col(column), F.lit(most))
    return df.filter(F.col(column).isNotNull()).groupBy(F.floor(value / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def against_offline(live: DataFrame, offline: DataFrame) -> DataFrame:
    """n, pearson and mean_abs_delta of users (user, score) in both tables."""
    both = live.select("user", "score").join(offline.select("user", F.col("score").alias("offline")), "user").dropna()
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("offline", "score").alias("pearson"), F.avg(F.abs(F.col("offline") - F.col("score"))).alias("mean_abs_delta"))
