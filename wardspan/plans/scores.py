"""Queries on scores: rules, scaling, thresholds, tiers, peers and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.tiers import tier
from wardspan.operators import catalog, evaluate, history, models, scoring
from wardspan.operators import features as X
from wardspan.plans.activity import DAILY_SQL, LIVE_FEATURES, LIVE_SQL, PROFILE_SQL, live_events, profile
from wardspan.plans.history import FLAGS_SQL, NUMBERED
from wardspan.operators.cuts import cut
from wardspan.plans.named import query
from wardspan.sources.tables import EVENTS_SQL, events, table

ROLE = ["login_count_sum", "files_accessed_sum", "usb_events_sum", "email_count_sum"]
DEVIATION = [*ROLE, "http_count_sum", "n_archive_files_sum", "n_exe_files_sum", "suspicious_http_sum", "external_emails_sum", "n_bcc_email_sum"]
LIVE_RULE = scoring.LIVE_RULE
BASE = f"WITH {EVENTS_SQL}, {DAILY_SQL}, {PROFILE_SQL}"


def rule_sql(over: str) -> str:
    return "round(" + " + ".join(f"least(sum({c}) {over}, {cap}) * {w} / {cap}" for c, (w, cap) in LIVE_RULE.items()) + ", 4)"


@query(f'WITH {EVENTS_SQL}, {LIVE_SQL} SELECT event_id, {rule_sql("OVER (PARTITION BY " + chr(34) + "user" + chr(34) + " ORDER BY event_ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)")} AS rule_live FROM live')
def live_rule_score(spark, sf_dir) -> DataFrame:
    rolled = history.rolling(live_events(spark, sf_dir), list(LIVE_RULE))
    return rolled.select("event_id", scoring.live_rule({f"{c}_in_window": v for c, v in LIVE_RULE.items()}).alias("rule_live"))


BATCH_SQL = f"""raw AS (SELECT *, {' + '.join(f'CASE WHEN max({c}) OVER () > 0 THEN {w} * {c} / max({c}) OVER () ELSE 0 END' for c, w in scoring.BATCH_RULE.items())} AS raw FROM profile),
  scored AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS rule_score FROM raw)"""


@query(f'{BASE}, {BATCH_SQL} SELECT "user", round(rule_score, 6) AS rule_score FROM scored')
def batch_rule_score(spark, sf_dir) -> DataFrame:
    return scoring.batch_rule(profile(spark, sf_dir)).select("user", F.round("rule_score", 6).alias("rule_score"))


def user_scores(spark, sf_dir) -> DataFrame:
    """user, score (mean rarity to four places), label and scenario, for evaluation."""
    flags = history.rarity_flags(events(spark, sf_dir))
    number = F.col("user").cast("int")
    return flags.groupBy("user").agg(F.round(F.avg("flags_fired") / 6, 4).alias("score")).withColumns(
        {"label": (number % 15 == 0).cast("int"), "scenario": F.when(number % 15 == 0, number % 3 + 1).otherwise(0).cast("int")}
    )


SCORES_SQL = f"""{EVENTS_SQL}, {NUMBERED}, {FLAGS_SQL}, scores AS (
  SELECT "user", round(avg(flags_fired) / 6, 4) AS score, CAST(CAST("user" AS INTEGER) % 15 = 0 AS INTEGER) AS label,
         CASE WHEN CAST("user" AS INTEGER) % 15 = 0 THEN CAST("user" AS INTEGER) % 3 + 1 ELSE 0 END AS scenario FROM flags GROUP BY "user")"""


@query(f'WITH {SCORES_SQL}, {DAILY_SQL}, {PROFILE_SQL}, {BATCH_SQL}, w AS (SELECT s."user", 0.25 * rule_score + 0.75 * score AS raw FROM scored s JOIN scores USING ("user")) SELECT "user", round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS wa_score FROM w')
def weighted_average(spark, sf_dir) -> DataFrame:
    both = scoring.batch_rule(profile(spark, sf_dir)).select("user", "rule_score").join(user_scores(spark, sf_dir), "user")
    return scoring.weighted_average(both, "rule_score", "score").select("user", F.round("wa_score", 6).alias("wa_score"))


CURVE_SQL = """steps AS (SELECT round(score, 6) AS score, CAST(sum(label) AS BIGINT) AS p, count(*) AS n FROM scores GROUP BY 1),
  curve AS (SELECT score, p, n, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) - CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
            CAST(sum(p) OVER () AS BIGINT) AS positives, CAST(sum(n) OVER () AS BIGINT) - CAST(sum(p) OVER () AS BIGINT) AS negatives FROM steps),
  pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / positives AS recall, 2 * tp / (tp + fp + positives) AS f1, tp + fp AS n_flagged FROM curve),
  best AS (SELECT * FROM pr ORDER BY round(f1, 12) DESC, threshold LIMIT 1)"""


@query(f"""WITH {SCORES_SQL}, {CURVE_SQL} SELECT round(threshold, 6) AS high, round(least((SELECT quantile_cont(score, 0.99) FROM scores WHERE label = 0), threshold - 1e-6), 6) AS medium FROM best""")
def tier_thresholds(spark, sf_dir) -> DataFrame:
    return evaluate.thresholds(user_scores(spark, sf_dir), places=6).select(F.round("high", 6).alias("high"), F.round("medium", 6).alias("medium"))


@query(f"WITH {SCORES_SQL}, {CURVE_SQL} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n_flagged FROM best")
def f1_optimal_threshold(spark, sf_dir) -> DataFrame:
    return evaluate.best_f1(user_scores(spark, sf_dir), places=6).select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n_flagged")


@query(f"WITH {SCORES_SQL} SELECT round(least(avg(score) + 3 * stddev_pop(score), 1), 6) AS high, round(least(avg(score) + 2 * stddev_pop(score), 1), 6) AS medium FROM scores")
def fallback_thresholds(spark, sf_dir) -> DataFrame:
    return scoring.fallback_thresholds(user_scores(spark, sf_dir), "score").select(F.round("high", 6).alias("high"), F.round("medium", 6).alias("medium"))


TIER = "CASE WHEN score >= 0.36 THEN 'High' WHEN score >= 0.33 THEN 'Medium' ELSE 'Low' END"


def tiered(spark, sf_dir) -> DataFrame:
    return user_scores(spark, sf_dir).withColumns({"tier": tier(F.col("score"), 0.36, 0.33), "source": F.lit("cert")})


@query(f"""WITH {SCORES_SQL}, t AS (SELECT *, {TIER} AS tier FROM scores) SELECT "user", score, tier FROM t
    ORDER BY CASE tier WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, score DESC, "user" LIMIT 20 OFFSET 10""")
def risk_ranking_page(spark, sf_dir) -> DataFrame:
    return catalog.list_users(tiered(spark, sf_dir), limit=20, offset=10).select("user", "score", "tier")


@query(f"WITH {SCORES_SQL}, t AS (SELECT *, {TIER} AS tier FROM scores) SELECT tier, count(*) AS n FROM t GROUP BY tier")
def tier_counts(spark, sf_dir) -> DataFrame:
    return tiered(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORES_SQL}, t AS (SELECT *, {TIER} AS tier FROM scores)
    SELECT count(*) AS total, count(*) FILTER (tier = 'High') AS high, count(*) FILTER (tier = 'Medium') AS medium, count(*) FILTER (tier = 'Low') AS low, round(avg(score), 6) AS mean,
           round(stddev_samp(score), 6) AS std, min(score) AS min, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, max(score) AS max FROM t""")
def score_stats(spark, sf_dir) -> DataFrame:
    s = catalog.stats(tiered(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p50", "p90")})


GROUPED_SQL = f"grouped AS (SELECT *, CAST(\"user\" AS INTEGER) % 8 AS peer_group FROM profile), means AS (SELECT peer_group, count(*) AS peer_size, {', '.join(f'avg({c}) AS {c}_m' for c in DEVIATION)} FROM grouped GROUP BY peer_group)"


def grouped(spark, sf_dir) -> DataFrame:
    return profile(spark, sf_dir).withColumn("peer_group", F.col("user").cast("int") % 8)


@query(f'{BASE}, {GROUPED_SQL} SELECT "user", peer_group, peer_size, ' + ", ".join(f"round({c} / greatest({c}_m, 1), 6) AS {c}_peer_ratio" for c in ROLE) + " FROM grouped JOIN means USING (peer_group)")
def peer_ratio(spark, sf_dir) -> DataFrame:
    return scoring.peer_ratios(grouped(spark, sf_dir), ROLE).select("user", "peer_group", "peer_size", *[F.round(f"{c}_peer_ratio", 6).alias(f"{c}_peer_ratio") for c in ROLE])


@query(f"""{BASE}, {GROUPED_SQL}, flat AS ({' UNION ALL '.join(f"SELECT g." + chr(34) + f"user" + chr(34) + f", peer_group, peer_size, '{c}' AS feature, CAST({c} AS DOUBLE) AS user_value, round({c}_m, 2) AS peer_mean, round({c} / greatest({c}_m, 1), 3) AS ratio FROM grouped g JOIN means USING (peer_group)" for c in DEVIATION)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY abs(ratio - 1) DESC, feature) AS place FROM flat) SELECT "user", peer_group, peer_size, feature, user_value, peer_mean, ratio, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""")
def peer_deviations_top8(spark, sf_dir) -> DataFrame:
    rows = grouped(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in DEVIATION})
    return scoring.peer_deviations(scoring.peer_ratios(rows, DEVIATION), DEVIATION)


@query(f"""{BASE}, {GROUPED_SQL} SELECT "user", peer_group, peer_size, {', '.join(f'round({c}_m, 6) AS {c}' for c in ROLE)}, least(8, {len(DEVIATION)}) AS deviations FROM grouped JOIN means USING (peer_group)""")
def peer_context(spark, sf_dir) -> DataFrame:
    """A user's peers with the four role means; the deviations themselves are those of peer_deviations_top8."""
    rows = grouped(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in DEVIATION})
    told = scoring.peer_context(scoring.peer_ratios(rows, list(dict.fromkeys([*DEVIATION, *ROLE]))), DEVIATION, ROLE)
    return told.select("user", "peer_group", "peer_size", *[F.round(f"role_means.{c}", 6).alias(c) for c in ROLE], F.size("deviations").alias("deviations"))


LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT \"user\", '{c}' AS feature, CAST({c} AS DOUBLE) - 3.1 AS value FROM profile" for c in DEVIATION) + ")"


def long(spark, sf_dir) -> DataFrame:
    return scoring.long_form(profile(spark, sf_dir), "user", DEVIATION).withColumn("value", F.col("value") - 3.1)


@query(f"{BASE}, {LONG_SQL} SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM long GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 15")
def attribution_mean_abs(spark, sf_dir) -> DataFrame:
    return long(spark, sf_dir).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(15)


@query(f'{BASE}, {LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY abs(value) DESC, feature) AS place FROM long) SELECT "user", feature, value, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5')
def user_top_attribution(spark, sf_dir) -> DataFrame:
    return scoring.top_attribution(long(spark, sf_dir), n=5).select("user", "feature", "value", "place")


@query(f"""{BASE}, {LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY abs(value) DESC, feature) AS place FROM long),
    p AS (SELECT *, sum(abs(value)) OVER (PARTITION BY "user") AS total, row_number() OVER (PARTITION BY "user" ORDER BY value <= 0, place) AS k FROM r WHERE place <= 5)
    SELECT "user", 'Flagged: ' || string_agg(feature || ' (' || printf('%.1f', abs(value) / total * 100) || '%)', '; ' ORDER BY place) AS reason FROM p WHERE value > 0 AND k <= 3 GROUP BY "user" """)
def top_positive_reasons(spark, sf_dir) -> DataFrame:
    from wardspan.functions.tiers import NO_DRIVER, reason

    top = scoring.top_attribution(long(spark, sf_dir), n=5)
    features = top.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("place", "feature", "value"))).alias("features"))
    return features.select("user", reason(F.col("features"), F.lit("High")).alias("reason")).filter(F.col("reason") != NO_DRIVER)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings),
    s AS (SELECT vec_id, r, list_transform(r, lambda x: sign(x) * x * x) AS q FROM e), m AS (SELECT *, list_max(list_transform(q, lambda x: abs(x))) AS top FROM s)
    SELECT vec_id, round(list_sum(list_transform(r, lambda x: x * x)) / len(r), 6) AS error, round(CASE WHEN top > 0 THEN q[1] / top * 0.8 ELSE q[1] END, 6) + 0.0 AS first_share, round(list_max(list_transform(q, lambda x: x / top * 0.8)), 6) AS most FROM m""")
def residual_attribution(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("r"))
    a = e.withColumn("a", scoring.residual_attribution(F.col("r"), F.lit(0.8)))
    return a.select("vec_id", F.round(scoring.mean_square(F.col("r")), 6).alias("error"), (F.round(F.col("a")[0], 6) + 0.0).alias("first_share"), F.round(F.array_max("a"), 6).alias("most"))


@query(f'{BASE} SELECT "user", ' + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_z" for c in ROLE) + " FROM profile")
def standard_scale(spark, sf_dir) -> DataFrame:
    return scoring.standard_scale(profile(spark, sf_dir), ROLE).select("user", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in ROLE])


QUARTILES = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for c in ROLE for n, q in (("a", 0.25), ("b", 0.5), ("c", 0.75)))


@query(f'{BASE}, q AS (SELECT {QUARTILES} FROM profile) SELECT "user", ' + ", ".join(f"round(({c} - {c}_b) / CASE WHEN {c}_c = {c}_a THEN 1 ELSE {c}_c - {c}_a END, 6) AS {c}_r" for c in ROLE) + " FROM profile, q")
def robust_scale(spark, sf_dir) -> DataFrame:
    return scoring.robust_scale(profile(spark, sf_dir), ROLE).select("user", *[F.round(f"{c}_r", 6).alias(f"{c}_r") for c in ROLE])


@query(f"""WITH {SCORES_SQL}, c AS (SELECT quantile_cont(score, 0.9) AS high, quantile_cont(score, 0.7) AS medium, count(*) AS n FROM scores),
    t AS (SELECT scores.*, CASE WHEN score >= high THEN 'High' WHEN score >= medium THEN 'Medium' ELSE 'Low' END AS tier, n FROM scores, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('42:' || "user"), "user") AS place, count(*) OVER (PARTITION BY tier) AS size FROM t)
    SELECT "user", score, label, scenario, tier FROM r WHERE place <= greatest(1, round(40 * size / n))""")
def stratified_tier_sample(spark, sf_dir) -> DataFrame:
    return catalog.stratified_sample(user_scores(spark, sf_dir), 40)


@query(f"""WITH {SCORES_SQL}, p AS (SELECT * FROM scores WHERE label = 1), o AS (SELECT * FROM scores WHERE label <> 1 ORDER BY md5('42:' || "user"), "user" )
    SELECT "user", label FROM p UNION ALL (SELECT "user", label FROM o LIMIT greatest(0, 40 - (SELECT count(*) FROM p)))""")
def cohort_sample(spark, sf_dir) -> DataFrame:
    return catalog.cohort_sample(user_scores(spark, sf_dir), 40).select("user", "label")


@query(f"""WITH {SCORES_SQL}, t AS (SELECT *, {TIER} AS tier FROM scores), asked AS (SELECT "user" FROM scores UNION ALL SELECT 'nobody'),
    b AS (SELECT * FROM t WHERE CAST("user" AS INTEGER) % 3 = 0), l AS (SELECT * FROM t WHERE CAST("user" AS INTEGER) % 2 = 0)
    SELECT a."user", coalesce(b.score, l.score * 2, 0) AS score, coalesce(b.tier, CASE WHEN l.score * 2 >= 0.7 THEN 'High' WHEN l.score * 2 >= 0.4 THEN 'Medium' WHEN l.score IS NOT NULL THEN 'Low' END, 'Low') AS tier,
           CASE WHEN b."user" IS NOT NULL THEN 'cert' ELSE 'cloud' END AS source
    FROM asked a LEFT JOIN b USING ("user") LEFT JOIN l USING ("user") WHERE b."user" IS NOT NULL OR l."user" IS NOT NULL OR a."user" IN (SELECT "user" FROM scores)""")
def user_details(spark, sf_dir) -> DataFrame:
    """Batch users by three, live users by two, the others have events only; one asked user is unknown."""
    known, number = tiered(spark, sf_dir), F.col("user").try_cast("int")
    asked = known.select("user").unionByName(known.limit(1).select(F.lit("nobody").alias("user")))
    live = known.filter(number % 2 == 0).select("user", (F.col("score") * 2).alias("score"))
    return catalog.details(asked, known.filter(number % 3 == 0), live, known.select("user"))


@query()
def kmeans_peers(spark, sf_dir) -> DataFrame:
    found = models.kmeans_peers(profile(spark, sf_dir), ROLE, 5, F.col("user").cast("int") % 15 != 0)
    return scoring.peer_ratios(found, ROLE).select("user", "peer_group", "peer_size", *[f"{c}_peer_ratio" for c in ROLE])


@query()
def autoencoder_score(spark, sf_dir) -> DataFrame:
    days = X.cloud_user_day(events(spark, sf_dir)).withColumn("key", F.concat_ws("/", "user", F.col("day").cast("string")))
    model = models.fit_autoencoder(days, X.CLOUD, "key", F.col("user").cast("int") % 15 != 0, time="day")
    scored = models.autoencoder_score(days, model)
    return scored.select("user", "day", "error", "score", scoring.residual_attribution(F.col("residuals"), F.col("score")).alias("attribution"))


@query()
def cloud_live_score(spark, sf_dir) -> DataFrame:
    """Each user's latest day, with the days before as history, by a network of normal users' days."""
    e = events(spark, sf_dir)
    days = X.cloud_user_day(e).withColumn("key", F.concat_ws("/", "user", F.col("day").cast("string")))
    model = models.fit_autoencoder(days, X.CLOUD, "key", F.col("user").cast("int") % 15 != 0, time="day")
    return models.autoencoder_score(X.cloud_latest_day(e), model).select("user", "day", F.col("score").alias("ae_live"))


@query()
def endpoint_live_score(spark, sf_dir) -> DataFrame:
    """Each user's 71 features, with the means of K-means peers, by a network of normal users."""
    daily = cut(X.live_daily(live_events(spark, sf_dir)))
    users = cut(X.user_profile(daily, X.DAILY))
    peers = scoring.means_of_peers(models.kmeans_peers(users, X.PEERS, 8), X.PEERS)
    vector = X.user_vector(daily, peers)
    model = models.fit_autoencoder(vector, X.VECTOR, "user", F.col("user").cast("int") % 15 != 0)
    return models.autoencoder_score(vector, model).select("user", F.col("score").alias("ae_live"))


@query()
def isolation_score(spark, sf_dir) -> DataFrame:
    return models.isolation_score(profile(spark, sf_dir), ROLE, "user", normal=F.col("user").cast("int") % 15 != 0, share=0.8).select("user", "if_score")


@query()
def kfold_inductive(spark, sf_dir) -> DataFrame:
    users = profile(spark, sf_dir).withColumn("label", (F.col("user").cast("int") % 15 == 0).cast("int"))
    return models.kfold_scores(users, [f"{c}_mean" for c in X.DAILY], "user", "label")


@query()
def stacked_score(spark, sf_dir) -> DataFrame:
    both = scoring.batch_rule(profile(spark, sf_dir)).select("user", "rule_score").join(user_scores(spark, sf_dir), "user")
    return models.stacked(both, ["rule_score", "score"], "label", "user").select("user", "label", "fold", "stack_score")


@query()
def boosted_score(spark, sf_dir) -> DataFrame:
    """Boosted trees on the users' 63 figures, fitted on pseudo-labels of their reconstruction scores."""
    users = profile(spark, sf_dir)
    features = [c for c in users.columns if c.endswith(("_mean", "_max", "_sum"))]
    model = models.fit_autoencoder(users, features, "user", F.col("user").cast("int") % 15 != 0)
    scored = models.autoencoder_score(users, model).select("user", F.col("score").alias("ae_score"), *features)
    return models.boosted(scored, features, "ae_score").select("user", "ae_score", "pseudo", "boost_score")
