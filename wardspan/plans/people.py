"""Queries on identities, labels and joins of populations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions import texts as X
from wardspan.operators import catalog, ranges
from wardspan.plans.named import query
from wardspan.sources.tables import EVENTS_SQL, events, table


@query(r"""WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'AIDA' || c_custkey WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN '?' ELSE c_name END AS name FROM customer)
    SELECT c_custkey, name FROM c WHERE name <> '' AND name NOT IN ('?', 'HIDDEN_DUE_TO_SECURITY_REASONS') AND NOT regexp_matches(name, '^[0-9]+$') AND NOT starts_with(name, 'AIDA') AND NOT starts_with(name, 'AROA')""")
def clean_identity_filter(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("AIDA"), key.cast("string"))).when(key % 5 == 1, key.cast("string")).when(key % 5 == 2, "?").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).filter(X.is_identity(F.col("name")))


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS name FROM part), n AS (SELECT lower(name) AS canonical, name, count(*) AS n FROM p GROUP BY ALL)
    SELECT canonical, name AS display, CAST(sum(n) OVER (PARTITION BY canonical) AS BIGINT) AS total FROM n QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY n DESC, name) = 1""")
def canonical_user(spark, sf_dir) -> DataFrame:
    """The most frequent spelling of each name."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return catalog.display_names(table(spark, sf_dir, "part").select(name.alias("name")), "name")


@query("SELECT c_custkey, 'USR-' || upper(substr(sha256('pepper:' || c_name), 1, 8)) AS anonymous FROM customer")
def anonymise_users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.anonymous(F.col("c_name"), "pepper").alias("anonymous"))


@query("SELECT d.doc_id, d.source, coalesce(l.quality, 0)::INTEGER AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_left_join(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("labelled"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.select("doc_id", "source", F.coalesce("quality", F.lit(0)).cast("int").alias("quality"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def normals_anti_join(spark, sf_dir) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(toxic, "doc_id", "left_anti")


@query("SELECT o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL")
def offline_vs_live_inner(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "o_totalprice", "c_acctbal").dropna()


@query("""WITH i AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS "user", CAST(min(ts) AS DATE) AS s FROM events WHERE user_id % 15 = 0 GROUP BY user_id),
    d AS (SELECT "user", CAST(unnest(generate_series(s, s + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM i), e AS (SELECT CAST(user_id AS VARCHAR) AS "user", CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
    SELECT e."user", e.day, n, CAST(d.day IS NOT NULL AS INTEGER) AS malicious FROM e LEFT JOIN d ON e."user" = d."user" AND e.day = d.day""")
def interval_label_days(spark, sf_dir) -> DataFrame:
    """Four days from the first event of every fifteenth user are labelled."""
    e = events(spark, sf_dir).withColumn("day", F.to_date("event_ts"))
    spans = e.filter(F.col("user").cast("int") % 15 == 0).groupBy("user").agg(F.min("day").alias("s"))
    days = spans.select("user", F.explode(F.sequence("s", F.date_add("s", 3))).alias("day")).withColumn("malicious", F.lit(1))
    counts = e.groupBy("user", "day").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(days, ["user", "day"], "left").withColumn("malicious", F.coalesce("malicious", F.lit(0)))


@query("SELECT c.c_custkey, c.c_nationkey, n.n_name, s.n AS suppliers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = c.c_nationkey")
def user_source_lookup(spark, sf_dir) -> DataFrame:
    """A lookup of small tables from each row, as user to source and peer means."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    suppliers = catalog.counts_by(table(spark, sf_dir, "supplier"), "s_nationkey").select(F.col("s_nationkey").alias("c_nationkey"), F.col("n").alias("suppliers"))
    return catalog.with_lookups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], [nation], [suppliers])


@query(f"""WITH {EVENTS_SQL}, batch AS (SELECT DISTINCT "user" FROM ev WHERE source = 'cert_file'), live AS (SELECT DISTINCT "user" FROM ev WHERE source = 'aws_cloudtrail' AND k < 40)
    SELECT "user", 'cert' AS source FROM batch UNION ALL SELECT "user", 'cloud' FROM live WHERE "user" NOT IN (SELECT "user" FROM batch) UNION ALL SELECT 'x' || "user", 'cloud' FROM live""")
def two_populations(spark, sf_dir) -> DataFrame:
    """Batch users, and live users that aren't among them."""
    e = events(spark, sf_dir)
    batch = e.filter("source = 'cert_file'").select("user").distinct()
    live = e.filter("source = 'aws_cloudtrail' AND k < 40").select("user").distinct()
    live = live.unionByName(live.select(F.concat(F.lit("x"), "user").alias("user")))
    none = F.lit(0.0).alias("score")
    return catalog.all_users(batch.select("user", none), live.select("user", none), 0.8, 0.5).select("user", "source")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def status_counts(spark, sf_dir) -> DataFrame:
    counts = catalog.counts_by(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    return counts.select(F.col("o_orderstatus").alias("status"), "n", F.round("total", 2).alias("total"))


@query("SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2) / (SELECT count(*) FROM orders), 9) AS rank_share FROM orders")
def rank_normalised(spark, sf_dir) -> DataFrame:
    """Average rank over the number of rows, by counts per value in ranges of values."""
    ranked = ranges.rank_share(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "rank_share")
    return ranked.select("o_orderkey", F.round("rank_share", 9).alias("rank_share"))
