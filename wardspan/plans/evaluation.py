"""Queries on detector quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.operators import evaluate, ranges
from wardspan.operators import history as H
from wardspan.operators.cuts import cut
from wardspan.plans.history import FLAGS_SQL, NUMBERED
from wardspan.plans.named import query
from wardspan.plans.scores import CURVE_SQL, SCORES_SQL, user_scores
from wardspan.sources.tables import EVENTS_SQL, events, table

WITH = f"WITH {SCORES_SQL}, {CURVE_SQL}"
rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query(f"{WITH} SELECT round(sum(p * (negatives - fp) + p * (n - p) / 2) / (max(positives) * max(negatives)), 6) AS auroc FROM curve")
def auroc(spark, sf_dir) -> DataFrame:
    return evaluate.auroc(user_scores(spark, sf_dir), places=6).select(*rounded("auroc"))


@query(f"{WITH} SELECT round(sum(p / positives * tp / (tp + fp)), 6) AS average_precision FROM curve")
def average_precision(spark, sf_dir) -> DataFrame:
    return evaluate.average_precision(user_scores(spark, sf_dir), places=6).select(*rounded("average_precision"))


@query(f"{WITH} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def pr_curve(spark, sf_dir) -> DataFrame:
    return evaluate.precision_recall(user_scores(spark, sf_dir), places=6).select("threshold", *rounded("precision", "recall", "f1"))


@query(f"{WITH} SELECT score AS threshold, round(fp / negatives, 6) AS fpr, round(tp / positives, 6) AS tpr FROM curve")
def roc_curve(spark, sf_dir) -> DataFrame:
    return evaluate.roc(user_scores(spark, sf_dir), places=6).select("threshold", *rounded("fpr", "tpr"))


@query(f"{WITH} SELECT count(*) FILTER (score >= 0.33 AND label = 1) AS tp, count(*) FILTER (score >= 0.33 AND label = 0) AS fp, count(*) FILTER (score < 0.33 AND label = 1) AS fn, count(*) FILTER (score < 0.33 AND label = 0) AS tn FROM scores")
def confusion_at_threshold(spark, sf_dir) -> DataFrame:
    return evaluate.confusion(user_scores(spark, sf_dir), 0.33)


@query(f"""WITH {SCORES_SQL}, q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM scores),
    b AS (SELECT score, label, CAST(len(list_filter(cuts, lambda c: c < score)) AS INTEGER) AS bin FROM scores, q) SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share FROM b GROUP BY bin""")
def calibration_bins(spark, sf_dir) -> DataFrame:
    return evaluate.calibration(user_scores(spark, sf_dir)).select("bin", "n", *rounded("mean_score", "share"))


# The shares of users that are tried as contamination.
SHARES = [0.03, 0.05, 0.07, 0.09, 0.12]


@query(f"""WITH {SCORES_SQL}, q AS (SELECT unnest({SHARES}::DOUBLE[]) AS share, unnest(quantile_cont(score, [0.97, 0.95, 0.93, 0.91, 0.88])) AS threshold FROM scores),
    s AS (SELECT share, threshold, count(*) FILTER (score >= threshold) AS n_flagged, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (label = 1) AS positives FROM scores, q GROUP BY share, threshold)
    SELECT share, round(threshold, 6) AS threshold, n_flagged, round(tp / n_flagged, 6) AS precision, round(tp / positives, 6) AS recall, round(2 * tp / (n_flagged + positives), 6) AS f1 FROM s""")
def flagged_shares(spark, sf_dir) -> DataFrame:
    return evaluate.flagged_share(user_scores(spark, sf_dir), "score", "label", SHARES).select("share", "n_flagged", *rounded("threshold", "precision", "recall", "f1"))


@query(f"""WITH {EVENTS_SQL}, {NUMBERED}, {FLAGS_SQL} SELECT CAST(CAST("user" AS INTEGER) % 15 = 0 AS INTEGER) AS label, {', '.join(f'round(avg(CAST({f} AS INTEGER)) * 100, 6) AS {f}' for f in H.FLAGS)} FROM flags GROUP BY 1""")
def flag_rate_by_class(spark, sf_dir) -> DataFrame:
    flags = H.rarity_flags(events(spark, sf_dir)).withColumn("label", (F.col("user").cast("int") % 15 == 0).cast("int"))
    return flags.groupBy("label").agg(*[F.round(F.avg(F.col(f).cast("int")) * 100, 6).alias(f) for f in H.FLAGS])


@query(f"""WITH {SCORES_SQL}, f AS (SELECT count(*) AS fp FROM scores WHERE scenario = 0 AND score >= 0.33)
    SELECT scenario, count(*) FILTER (score >= 0.33) AS detected, count(*) AS total, round(2 * count(*) FILTER (score >= 0.33) / (count(*) FILTER (score >= 0.33) + any_value(fp) + count(*)), 6) AS f1
    FROM scores, f WHERE scenario > 0 GROUP BY scenario""")
def scenario_recall(spark, sf_dir) -> DataFrame:
    return evaluate.scenario_recall(user_scores(spark, sf_dir), 0.33).withColumn("f1", F.round("f1", 6))


@query(f"WITH {SCORES_SQL} SELECT scenario, round(avg(score), 6) AS mean_score, count(*) AS n FROM scores GROUP BY scenario")
def mean_score_by_scenario(spark, sf_dir) -> DataFrame:
    return user_scores(spark, sf_dir).groupBy("scenario").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORES_SQL}, o AS (SELECT "user", round((row_number() OVER (ORDER BY score, "user")) / 200.0, 6) AS offline FROM scores)
    SELECT count(*) AS n, round(corr(offline, score), 6) AS pearson, round(avg(abs(offline - score)), 6) AS mean_abs_delta FROM o JOIN scores USING ("user")""")
def live_vs_offline(spark, sf_dir) -> DataFrame:
    """The ranks of the users stand for offline scores."""
    live = cut(user_scores(spark, sf_dir).select("user", "score"))
    placed = ranges.numbered(live, [F.col("score"), F.col("user")], "place")
    offline = placed.select("user", F.round(F.col("place") / 200.0, 6).alias("score"))
    return evaluate.against_offline(live, offline).select("n", *rounded("pearson", "mean_abs_delta"))


@query("""WITH s AS (SELECT round(value, 6) AS v FROM events), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM s)
    SELECT round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, max(v) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(v) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(v) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM o""")
def latency_percentiles(spark, sf_dir) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), "value", 6).withColumn("mean", F.round("mean", 6))


@query("SELECT CAST(floor(least(value, 50) / 5) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def size_histogram(spark, sf_dir) -> DataFrame:
    return evaluate.clipped_histogram(table(spark, sf_dir, "events"), "value", 5, 50)
