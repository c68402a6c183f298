"""Queries of text functions on pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions import patterns as P
from wardspan.functions import texts as X
from wardspan.plans.named import query
from wardspan.sources.tables import table

_words = lambda names: "|".join(n.replace(".", "\\.") for n in names)
# The word lists of the two dialects, and words of the table's addresses, so that each flag is met.
KEYS = {"job": P.LIVE_JOB, "cloud": P.LIVE_CLOUD, "suspicious": P.LIVE_SUSPICIOUS, "train_job": P.TRAIN_JOB, "train_cloud": P.TRAIN_CLOUD, "example_org": ["example.org"]}


@query(f"SELECT page_id, {', '.join(f'CAST(regexp_matches(lower(url), {chr(39)}{_words(v).replace(chr(63), chr(92) + chr(63))}{chr(39)}) AS INTEGER) AS {k}' for k, v in KEYS.items())} FROM pages")
def url_keyword_flags(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[P.any_of(F.col("url"), v).cast("int").alias(k) for k, v in KEYS.items()])


@query(r"SELECT page_id, lower(regexp_extract(url, '\.(\w+)$', 1)) AS extension, CASE WHEN contains(url, '.') THEN lower(list_last(string_split(url, '.'))) ELSE '' END AS after_dot FROM pages")
def file_extension(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.extension(F.col("url")).alias("extension"), X.extension_live(F.col("url")).alias("after_dot"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '@([\w.-]+)', 1), '') AS domain FROM documents WHERE contains(text, '@')")
def email_domain(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", X.email_domain(F.col("text")).alias("domain"))


@query(r"SELECT regexp_extract(text, '@([\w.-]+)', 1) AS domain, count(*) AS n FROM documents WHERE regexp_extract(text, '@([\w.-]+)', 1) <> '' GROUP BY 1 ORDER BY n DESC, domain LIMIT 1")
def sender_domain_mode(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(X.email_domain(F.col("text")).alias("domain")).filter("domain IS NOT NULL")
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(1)


@query("""WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, count(*) FILTER (role = before) AS same_role_again, CAST(max(length(text)) AS INTEGER) AS longest FROM c GROUP BY conv_id""")
def conversation_summary(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.count_if(F.coalesce(F.col("role") == F.col("before"), F.lit(False))).alias("same_role_again"), F.max(F.length("text")).alias("longest")
    )
