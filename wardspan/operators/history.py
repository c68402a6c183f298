"""Operators on a user's earlier events, in order of arrival.

All of them number a user's events once; whether a value is among the last
``cap`` events follows from the number of its previous occurrence, so no list of
events is collected. A user can hold a large share of all events, so work is
dealt by user and day (or hours, or numbers): what a part needs of the parts
before it are sums and last numbers of whole parts, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.functions import patterns as P
from wardspan.functions import times as T
from wardspan.operators.cuts import cut, join_summary

CAP = 500
MANY = 50
LOCAL_NAMES = ["127.0.0.1", "::1", "localhost", ""]
FLAGS = ["first_time_action", "new_ip", "off_hours", "high_volume", "sensitive_resource", "geo_rarity"]


def numbered(df: DataFrame, user: str = "user", order: tuple[str, ...] = ("event_ts", "event_id")) -> DataFrame:
    """seq: each user's events from 1, in order, and day_; a day's first number follows the counts of earlier days."""
    days = df.withColumn("day_", F.coalesce(F.to_date(order[0]), F.lit("0001-01-01").cast("date")))
    counts = days.groupBy(user, "day_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(W.partitionBy(user).orderBy("day_").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(user, "day_", F.coalesce(before, F.lit(0)).alias("before_"))
    place = F.row_number().over(W.partitionBy(user, "day_").orderBy(*order))
    return days.withColumn("place_", place).join(counts, [user, "day_"]).withColumn("seq", F.col("before_") + F.col("place_")).drop("place_", "before_")


def action_key() -> tuple[Column, Column]:
    key = F.lower(F.trim("action"))
    return key, key != ""


def ip_key() -> tuple[Column, Column]:
    key = F.trim("ip_address")
    return key, ~key.isin(LOCAL_NAMES)


def country_key() -> tuple[Column, Column]:
    key = F.upper(F.trim("country"))
    return key, key != ""


def with_unseen(df: DataFrame, kinds: dict[str, tuple[Column, Column]], cap: int | None = CAP, user: str = "user") -> DataFrame:
    """For each name in kinds (key, whether it counts): whether a counting key isn't among the user's last ``cap`` earlier events (None: all) of numbered().

    The numbered events are cut once, and the keys of all kinds are stacked in
    narrow rows. A block is as many numbers as ``cap``, so a key that comes again
    in its block was seen: of each block only a key's first and last number
    matter, which are sums, and the first is held against the last one of the
    block before. Only flags that are true come back to the events.
    """
    base = cut(df)
    keys = F.array(*[F.struct(F.lit(n).alias("kind_"), F.when(counts, key).alias("key_")) for n, (key, counts) in kinds.items()])
    block = F.floor((F.col("seq") - 1) / F.lit(CAP if cap is None else max(1, cap))).alias("block_")
    long = base.select(user, "seq", block, F.explode(keys).alias("k_")).select(user, "seq", "block_", "k_.*").filter("key_ IS NOT NULL")
    ends = long.groupBy(user, "kind_", "key_", "block_").agg(F.min("seq").alias("first_"), F.max("seq").alias("end_"))
    before = F.lag("end_").over(W.partitionBy(user, "kind_", "key_").orderBy("block_"))
    new = F.col("before_").isNull() if cap is None else F.col("before_").isNull() | (F.col("first_") - F.col("before_") > cap)
    fresh = ends.withColumn("before_", before).filter(new).groupBy(user, F.col("first_").alias("seq")).agg(*[F.max(F.col("kind_") == n).alias(n) for n in kinds])
    out = base.join(fresh, [user, "seq"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(False)) for n in kinds}).select(*df.columns, *kinds)


def first_time_action(df: DataFrame, cap: int | None = CAP) -> DataFrame:
    return with_unseen(df, {"first_time_action": action_key()}, cap)


def new_ip(df: DataFrame, cap: int | None = CAP) -> DataFrame:
    return with_unseen(df, {"new_ip": ip_key()}, cap)


def geo_rarity(df: DataFrame, cap: int | None = CAP) -> DataFrame:
    return with_unseen(df, {"geo_rarity": country_key()}, cap)


def high_volume(many: int = MANY, cap: int = CAP) -> Column:
    """More than ``many`` earlier events among the last ``cap``, of any age."""
    return F.least(F.col("seq") - 1, F.lit(cap)) > many


def rolling(df: DataFrame, columns: list[str], hours: int = 24, user: str = "user", ts: str = "event_ts") -> DataFrame:
    """Counts and sums over a user's last hours, this event included.

    Rows are dealt by user and stretch of as many hours, and lie in the next
    stretch too, so that a window never reaches out of its own; only user, time and
    the summed columns lie there twice. Sums of whole numbers are differences of
    two sums that grow with the rows, so a busy stretch takes linear time. Rows
    without a time are in one window by themselves.
    """
    length = hours * 3_600_000_000
    whole = {"tinyint", "smallint", "int", "bigint"}
    summed = {f"{c}_in_window": (f"s{i}_", dict(df.dtypes)[c] in whole) for i, c in enumerate(columns)} | {"events_in_window": ("one_", True)}
    kept = {f"c{i}_": c for i, c in enumerate(df.columns) if c != user}
    row = df.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], F.col(user).alias("user_"), T.micros(df, ts).alias("at_"), F.lit(1).cast("long").alias("one_"), *[F.col(c).alias(f"s{i}_") for i, c in enumerate(columns)])
    dealt = row.withColumn("copy_", F.explode(F.when(F.col("at_").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    dealt = dealt.withColumns({"stretch_": F.floor(F.col("at_") / length) + F.col("copy_")} | {k: F.when(F.col("copy_") == 0, F.col(k)) for k in kept})
    w = W.partitionBy("user_", "stretch_").orderBy("at_")
    upto, before, within = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(W.unboundedPreceding, -length - 1), w.rangeBetween(-length, 0)

    def inside(c: str, is_whole: bool) -> Column:
        if not is_whole:
            return F.sum(c).over(within)
        # Rows without a time are peers; nothing lies before them.
        sums = F.sum(c).over(upto) - F.when(F.col("at_").isNull(), F.lit(0)).otherwise(F.coalesce(F.sum(c).over(before), F.lit(0)))
        some = F.count(c).over(upto) - F.when(F.col("at_").isNull(), F.lit(0)).otherwise(F.count(c).over(before))
        return sums if c == "one_" else F.when(some > 0, sums)

    out = dealt.withColumns({n: inside(*told) for n, told in summed.items()}).filter("copy_ = 0")
    kept_as = {c: k for k, c in kept.items()} | {user: "user_"}
    return out.select(*[F.col(kept_as[c]).alias(c) for c in df.columns], "events_in_window", *[f"{c}_in_window" for c in columns])


def high_volume_in(df: DataFrame, hours: int = 1, many: int = MANY) -> DataFrame:
    """high_volume_in: more than ``many`` earlier events within some hours."""
    return rolling(df, [], hours).withColumn("high_volume_in", F.col("events_in_window") - 1 > many).drop("events_in_window")


def rarity_flags(df: DataFrame, cap: int | None = CAP, rows: DataFrame | None = None) -> DataFrame:
    """The six flags of each event, and rarity: their share, rounded to four places.

    ``rows`` are the events under a number row_ that df has too: the history is
    taken of the columns it needs there, and only its results are joined to df, so
    columns of df that nobody reads are never shuffled.
    """
    kinds = {"first_time_action": action_key(), "new_ip": ip_key(), "geo_rarity": country_key()}
    if rows is None:
        return flagged(with_unseen(numbered(df), kinds, cap).drop("day_"))
    told = with_unseen(numbered(rows.select("row_", "user", "event_ts", "event_id", "action", "ip_address", "country")), kinds, cap)
    return flagged(df.join(told.select("row_", "seq", *kinds), "row_"))


def event_flags(df: DataFrame) -> DataFrame:
    """The flags that follow from an event alone."""
    return df.withColumns({"off_hours": T.off_hours(F.col("event_ts")), "sensitive_resource": P.sensitive_resource(F.col("resource"))})


def flagged(out: DataFrame) -> DataFrame:
    """The flags that follow from an event and its number (seq) alone, beside the three of its history, and rarity; those of event_flags() may be there."""
    if not {"off_hours", "sensitive_resource"} <= set(out.columns):
        out = event_flags(out)
    out = out.withColumn("high_volume", high_volume())
    fired = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in FLAGS), F.lit(0))
    return out.withColumns({"flags_fired": fired, "rarity": F.round(fired / len(FLAGS), 4)})


def split_latest_day(df: DataFrame, day: str = "day") -> DataFrame:
    """is_latest: whether an event lies on its user's latest day, from one maximum a user; events without a day go."""
    dated = df.filter(F.col(day).isNotNull())
    last = dated.groupBy("user").agg(F.max(day).alias("last_"))
    return join_summary(dated, last, ["user"]).withColumn("is_latest", F.col(day) == F.col("last_")).drop("last_")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an upsert in that order leaves it."""
    fields = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in fields if c not in order])).alias("last_")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last_.{c}").alias(c) for c in fields])
