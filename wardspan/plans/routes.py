"""Queries of the service's read routes: searches, lookups of one user, live scores and their tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.tiers import RARITY, direction, tier
from wardspan.operators import catalog
from wardspan.operators import history as H
from wardspan.operators.cuts import cut
from wardspan.plans.history import FLAGS_SQL, NUMBERED
from wardspan.plans.named import query
from wardspan.plans.scores import BASE, LONG_SQL, SCORES_SQL, TIER, long, tiered
from wardspan.sources.tables import EVENTS_SQL, events

LIVE_SQL = f"""{EVENTS_SQL}, {NUMBERED}, {FLAGS_SQL}, live AS (SELECT "user", max_by(round(flags_fired / 6.0, 4), seq) AS rarity, max(seq) AS event_count FROM flags GROUP BY "user")"""


def live(spark, sf_dir) -> DataFrame:
    """Each user's rarity at the last event, and the number of events."""
    flags = H.rarity_flags(events(spark, sf_dir)).select("user", "seq", "rarity")
    return H.latest(flags, ["user"], ["seq"]).select("user", "rarity", F.col("seq").alias("event_count"))


@query(f"""WITH {SCORES_SQL}, t AS (SELECT *, {TIER} AS tier FROM scores) SELECT "user", score, tier FROM t WHERE contains(lower("user"), '1') AND tier <> 'High'""")
def user_search(spark, sf_dir) -> DataFrame:
    """Users of two tiers whose name holds a text, whatever its case and blanks around it."""
    users = cut(tiered(spark, sf_dir))
    found = [catalog.list_users(users, risk=risk, source="cert", q=" 1 ", limit=None) for risk in ("Medium", "Low")]
    return found[0].unionByName(found[1]).select("user", "score", "tier")


@query(f"WITH {LIVE_SQL} SELECT \"user\", rarity, event_count, CASE WHEN rarity >= 0.6 THEN 'High' WHEN rarity >= 0.4 THEN 'Medium' ELSE 'Low' END AS tier FROM live")
def live_rarity_tiers(spark, sf_dir) -> DataFrame:
    """All live scores, the rarest first, with the tiers of rarity."""
    return catalog.live_scores(live(spark, sf_dir)).withColumn("tier", tier(F.col("rarity"), *RARITY))


@query(f"""WITH {LIVE_SQL}, top AS (SELECT "user" FROM live ORDER BY rarity DESC, "user" LIMIT 1), asked AS (SELECT "user" FROM top UNION ALL SELECT 'nobody') SELECT a."user", rarity, event_count FROM asked a LEFT JOIN live USING ("user")""")
def live_score_lookup(spark, sf_dir) -> DataFrame:
    """The live score of the rarest user, and that of a user without one."""
    rows = cut(live(spark, sf_dir))
    names = [r["user"] for r in catalog.live_scores(rows).limit(1).collect()]
    out = catalog.live_score(rows, "nobody")
    for name in names:
        out = out.unionByName(catalog.live_score(rows, name))
    return out


@query(f"""WITH {EVENTS_SQL} SELECT "user", count(*) AS event_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(event_ts) AS last_seen, CAST(row_number() OVER (ORDER BY count(*) DESC, "user") AS BIGINT) AS place FROM ev GROUP BY "user" """)
def users_by_events(spark, sf_dir) -> DataFrame:
    """Users with their sources, in order of their number of events."""
    return catalog.users_by_events(events(spark, sf_dir))


@query(f"""WITH {SCORES_SQL} SELECT "user", round(score, 6) AS score, round(CASE WHEN CAST("user" AS INTEGER) % 2 = 0 THEN score * 2 ELSE score END, 6) AS ensemble_score, round(score, 6) AS wa_score FROM scores""")
def score_fallback(spark, sf_dir) -> DataFrame:
    """Older score fields: their own value where it is over 0, else the main score."""
    rows = tiered(spark, sf_dir).withColumns({"ensemble_score": F.when(F.col("user").cast("int") % 2 == 0, F.col("score") * 2).otherwise(0.0), "wa_score": F.lit(None).cast("double")})
    told = catalog.with_fallback(rows, ["ensemble_score", "wa_score"])
    return told.select("user", *[F.round(c, 6).alias(c) for c in ("score", "ensemble_score", "wa_score")])


@query(f"""{BASE}, {LONG_SQL} SELECT "user", feature, round(value, 6) AS value, CASE WHEN value > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM long""")
def attribution_directions(spark, sf_dir) -> DataFrame:
    return long(spark, sf_dir).select("user", "feature", F.round("value", 6).alias("value"), direction(F.col("value")).alias("direction"))


@query(f"""{BASE}, {LONG_SQL}, sc AS (WITH {SCORES_SQL} SELECT "user", score, {TIER} AS tier FROM scores ORDER BY score DESC, "user" LIMIT 1),
    r AS (SELECT l.*, row_number() OVER (ORDER BY abs(value) DESC, feature) AS place FROM long l JOIN sc USING ("user"))
    SELECT "user", round(score, 6) AS score, tier, feature, round(value, 6) AS value, CAST(place AS INTEGER) AS place FROM r JOIN sc USING ("user") WHERE place <= 5""")
def top_user_detail(spark, sf_dir) -> DataFrame:
    """The highest user's score, tier and five features."""
    users = cut(tiered(spark, sf_dir))
    first = users.orderBy(F.desc("score"), "user").first()
    told = catalog.user_detail(users, long(spark, sf_dir), first["user"] if first else "")
    flat = told.select("user", F.round("score", 6).alias("score"), "tier", F.explode("features").alias("f"))
    return flat.select("user", "score", "tier", "f.feature", F.round("f.value", 6).alias("value"), "f.place")
