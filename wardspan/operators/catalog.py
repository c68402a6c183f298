"""What the service's routes return, as DataFrames."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.tiers import LIVE, direction, reason, tier, tier_rank
from wardspan.operators import ranges
from wardspan.operators.cuts import cut, join_summary
from wardspan.operators.scoring import top_attribution

TIERS = ["High", "Medium", "Low"]
ORIGINS = ["all", "cert", "cloud"]


def all_users(batch: DataFrame, live: DataFrame, high: float, medium: float) -> DataFrame:
    """Batch users with data-driven tiers, and live users that aren't among them with fixed ones: user, score, source, tier."""
    cert = batch.select("user", F.col("score").cast("double"), F.lit("cert").alias("source")).withColumn("tier", tier(F.col("score"), high, medium))
    cloud = live.join(batch.select("user"), "user", "left_anti").select("user", F.col("score").cast("double"), F.lit("cloud").alias("source"))
    return cert.unionByName(cloud.withColumn("tier", tier(F.col("score"), *LIVE)))


def display_names(df: DataFrame, name: str) -> DataFrame:
    """canonical (lower case), display (its most frequent spelling, of several the first) and total of a column of names; nulls are one name."""
    counts = df.groupBy(F.lower(name).alias("canonical"), F.col(name).alias("name_")).agg(F.count(F.lit(1)).alias("n_"))
    best = F.min(F.struct((-F.col("n_")).alias("o"), "name_")).alias("best_")
    return counts.groupBy("canonical").agg(best, F.sum("n_").alias("total")).select("canonical", F.col("best_.name_").alias("display"), "total")


def counts_by(df: DataFrame, key: str, summed: str | None = None) -> DataFrame:
    """n, and total of a column, of each value of a key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *([F.sum(summed).alias("total")] if summed else []))


def primary_source(events: DataFrame) -> DataFrame:
    """user and source: the source of most of a user's events, of several the first by name."""
    counts = events.groupBy("user", "source").agg(F.count(F.lit(1)).alias("n_"))
    return counts.groupBy("user").agg(F.min(F.struct((-F.col("n_")).alias("o"), "source")).alias("s_")).select("user", "s_.source")


def users_by_events(events: DataFrame) -> DataFrame:
    """user, event_count, sources and last_seen, and place: users in order of their number of events, then by name."""
    of = F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    users = events.groupBy("user").agg(F.count(F.lit(1)).alias("event_count"), of, F.max("event_ts").alias("last_seen"))
    return ranges.numbered(users, [F.desc("event_count"), F.col("user")], "place")


def with_lookups(df: DataFrame, keys: list[str], needed: list[DataFrame], wanted: list[DataFrame]) -> DataFrame:
    """df with the columns of tables that have each key once; rows without a row in the needed ones go, and those without one in a wanted one have nulls."""
    for table, how in [*((t, "inner") for t in needed), *((t, "left") for t in wanted)]:
        df = join_summary(df, table, keys, how)
    return df


def list_users(users: DataFrame, risk: str | None = None, source: str = "all", q: str = "", limit: int | None = 100, offset: int = 0) -> DataFrame:
    """A page of users: tier first, then score, then name; with limit None all of them from the offset on, in no order where that is 0."""
    if risk is not None and risk not in TIERS:
        raise ValueError(f"risk has to be one of {TIERS}")
    if source not in ORIGINS:
        raise ValueError(f"source has to be one of {ORIGINS}")
    if limit is not None and not 0 <= limit <= 5000 or offset < 0:
        raise ValueError("limit has to be 0 to 5000 or None, offset 0 or more")
    out = users if risk is None else users.filter(F.col("tier") == risk)
    out = out if source == "all" else out.filter(F.col("source") == source)
    if q.strip():
        out = out.filter(F.lower("user").contains(q.strip().lower()))
    if limit is None and not offset:
        return out
    out = out.orderBy(tier_rank(F.col("tier")), F.desc("score"), "user").offset(offset)
    return out if limit is None else out.limit(limit)


def stats(users: DataFrame) -> DataFrame:
    """Counts by tier and figures of the scores."""
    users = cut(users)
    p50, p90 = ranges.quantiles(users, {"score": [0.5, 0.9]})["score"]
    return users.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in TIERS], F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"), F.lit(p50).cast("double").alias("p50"), F.lit(p90).cast("double").alias("p90"), F.max("score").alias("max"),
    )


def user_detail(users: DataFrame, long: DataFrame, user: str, n: int = 5) -> DataFrame:
    """One row: score, tier, the n top features and a reason; no row for an unknown user."""
    top = top_attribution(long.filter(F.col("user") == user), n=n)
    feature = F.struct(F.col("place"), F.col("feature"), F.col("value"), direction(F.col("value")).alias("direction"))
    features = top.groupBy("user").agg(F.array_sort(F.collect_list(feature)).alias("features"))
    found = users.filter(F.col("user") == user).join(features, "user", "left")
    return found.withColumn("reason", reason(F.coalesce("features", F.array().cast("array<struct<place:int,feature:string,value:double,direction:string>>")), F.col("tier")))


def recent_events(events: DataFrame, user: str | None, now, hours: int = 24) -> DataFrame:
    """All events of a user (None: of all) that were taken in within some hours before a time, the newest first."""
    since = F.col("ingested_at") >= F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return events.filter(since if user is None else since & (F.col("user") == user)).orderBy(F.desc("ingested_at"), F.desc("event_id"))


def user_events(events: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """A user's newest events."""
    if not 0 <= limit <= 100:
        raise ValueError("limit has to be 0 to 100")
    return events.filter(F.col("user") == user).orderBy(F.desc("event_ts"), F.desc("event_id")).limit(limit)


def live_score(live: DataFrame, user: str) -> DataFrame:
    """One row, with nulls if the user has no live score."""
    asked = live.sparkSession.createDataFrame([(user,)], "user string")
    return asked.join(live.filter(F.col("user") == user), "user", "left")


def health(batch: DataFrame, live: DataFrame) -> DataFrame:
    counts = batch.agg(F.count(F.lit(1)).alias("batch_users")).crossJoin(live.agg(F.count(F.lit(1)).alias("live_users")))
    return counts.withColumn("status", F.lit("ok"))


def live_scores(live: DataFrame) -> DataFrame:
    """All live scores, the rarest first."""
    return live.orderBy(F.desc("rarity"), "user")


def details(asked: DataFrame, batch: DataFrame, live: DataFrame, known: DataFrame) -> DataFrame:
    """A row per asked user (user): the batch score with its tier, else the live one, else 0 for a user with events (known) only.

    batch has user, score and tier, live has user and score. Users that are in
    none of the three have no row.
    """
    score, rank = F.coalesce("score", F.lit(0.0)), F.lit
    found = (
        batch.select("user", F.struct(rank(0).alias("rank"), F.col("score").cast("double").alias("score"), F.col("tier"), F.lit("cert").alias("source")).alias("d"))
        .unionByName(live.select("user", F.struct(rank(1).alias("rank"), score.cast("double").alias("score"), tier(score, *LIVE).alias("tier"), F.lit("cloud").alias("source")).alias("d")))
        .unionByName(known.select("user", F.struct(rank(2).alias("rank"), F.lit(0.0).alias("score"), F.lit("Low").alias("tier"), F.lit("cloud").alias("source")).alias("d")))
    )
    first = found.join(asked.select("user").distinct(), "user", "left_semi").groupBy("user").agg(F.min("d").alias("d"))
    return first.select("user", F.round("d.score", 6).alias("score"), "d.tier", "d.source")


def with_fallback(df: DataFrame, columns: list[str], main: str = "score") -> DataFrame:
    """Old score columns where they are over 0, else the main score."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col(main)) for c in columns})


def draw(seed: int, key: str) -> Column:
    """A reproducible order: the MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def cohort_sample(df: DataFrame, n: int, label: str = "label", seed: int = 42, key: str = "user") -> DataFrame:
    """All rows of label 1 and, up to n rows, others in the order of draw(); all rows if there are no more than n."""
    insiders = df.filter(F.col(label) == 1)
    others = df.filter(F.coalesce(F.col(label) != 1, F.lit(True)))
    left = max(n - insiders.count(), 0)
    return insiders.unionByName(others.orderBy(draw(seed, key), key).limit(left))


def stratified_sample(df: DataFrame, n: int, score: str = "score", seed: int = 42, key: str = "user") -> DataFrame:
    """About n rows with the shares of the tiers by the 90th and 70th percentiles, one of each at least.

    The order within a tier is draw(), so a sample is the same on every run.
    """
    df = cut(df)
    high, medium = ranges.quantiles(df, {score: [0.9, 0.7]})[score]
    told = df.withColumn("tier", tier(F.col(score), F.lit(high).cast("double"), F.lit(medium).cast("double")))
    sizes = {r["tier"]: r["count"] for r in told.groupBy("tier").count().collect()}
    parts = []
    for name, size in sizes.items():  # three at most; a limit keeps each task's best rows and merges those
        of = told.filter(F.col("tier").eqNullSafe(F.lit(name)))
        parts.append(of.orderBy(draw(seed, key), key).limit(max(1, math.floor(n * size / sum(sizes.values()) + 0.5))))
    return reduce(DataFrame.unionByName, parts, told.limit(0)).select(*df.columns, "tier")
