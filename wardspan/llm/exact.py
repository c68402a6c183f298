"""Operator 10: exact deduplication by progressive refinement.

Rows are grouped by the length of their text, groups of several rows by a hash of
a short prefix, and only what is left is read in full and grouped by the full
hash. The first two levels work on narrow keys that one scan makes inside the
JVM; each counts its keys with map-side partial sums, and rows that are alone at
a level leave before the next one. The texts of the survivors come by a
semi-join on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import by_ids, cut, documents, free_name, join_summary

#: White space that doesn't count: blank, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """A text without white space; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def narrow_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The keys of the first two levels: the normalised text's bytes, and a hash of its first characters."""
    text = normalised(F.col(text_col))
    return df.select(F.col(id_col).alias("id_"), F.octet_length(text).alias("length_"), F.xxhash64(F.octet_length(text), F.substring(text, 1, PREFIX_CHARS)).alias("prefix_"))


def full_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key of the last level: the whole text's SHA-256; and the original text's length."""
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id_"), F.length(F.coalesce(text, F.lit(""))).alias("chars_"), F.unhex(F.sha2(normalised(text), 256)).alias("full_"))


def several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once.

    Each level has one key column of its own, so that a level's rows are dealt
    anew for the next.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select(key)
    return join_summary(rows, counts, [key])


def survivors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ids that have a row which isn't alone in its length and prefix, as id_; a null id is one of them."""
    rows = cut(narrow_keys(df, id_col, text_col))
    return cut(several(several(rows, "length_"), "prefix_").select("id_").distinct())


def best_of(rows: DataFrame) -> DataFrame:
    """Of each full hash the number of rows and the id that stays."""
    first = F.min(F.struct((-F.col("chars_")).alias("c"), F.col("id_").alias("i"))).alias("best_")
    return rows.groupBy("full_").agg(F.count(F.lit(1)).alias("group_size"), first).select("full_", "group_size", F.col("best_.i").alias("keep_id"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal without their white space; null is empty. The row with the
    longest original text, then the smallest id stays. Of repeated rows with one
    id all are marked kept, as nothing tells them apart: group_size counts them.
    The levels choose which rows are grouped; as every row's hash is returned,
    one more scan makes the hashes of all of them.
    """
    ids = survivors(df, id_col, text_col).withColumn("open_", F.lit(True))
    rows = full_keys(df, id_col, text_col)
    rows = cut(rows.join(ids, rows["id_"].eqNullSafe(ids["id_"]), "left").select(rows["id_"], "chars_", "full_", F.coalesce("open_", F.lit(False)).alias("open_")))
    grouped = join_summary(rows.filter("open_"), best_of(rows.filter("open_")), ["full_"]).select("id_", "keep_id", "group_size", "full_")
    alone = rows.filter("NOT open_").select("id_", F.col("id_").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "full_")
    return grouped.unionByName(alone).select(
        F.col("id_").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id_").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("full_")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of exact_groups(), with all columns of df, whatever their names; of repeated rows with one id and one text, any.

    Full hashes are made of the survivors' texts only. Rows of one id with
    different texts each stay or go with their own text. An empty table gives
    none.
    """
    ids = survivors(df, id_col, text_col)
    rows = cut(full_keys(by_ids(df, ids, "left_semi", id_col), id_col, text_col))
    judged = join_summary(rows, best_of(rows), ["full_"]).select("id_", "full_", F.col("id_").eqNullSafe(F.col("keep_id")).alias("kept_"))
    fate = cut(judged.groupBy("id_").agg(F.count(F.lit(1)).alias("n_"), F.count_if("kept_").alias("k_")))
    left = by_ids(df, fate.filter("k_ = 0").select("id_"), "left_anti", id_col)
    odd = cut(fate.filter("k_ > 0 AND n_ > 1").select("id_"))
    if odd.isEmpty():
        return left
    # Ids of several rows, some of which stay: of each that stays and text the longest row.
    mine = free_name(df)
    stays = judged.filter("kept_").select(F.struct("id_", "full_").alias(mine)).distinct()
    full = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    kept = by_ids(left, odd, "left_semi", id_col).join(stays, F.col(id_col).eqNullSafe(F.col(f"{mine}.id_")) & (full == F.col(f"{mine}.full_")))
    longest = F.max_by(F.struct(*df.columns), F.length(F.coalesce(text_col, F.lit("")))).alias("row_")
    return by_ids(left, odd, "left_anti", id_col).unionByName(kept.groupBy(mine).agg(longest).select("row_.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP10_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
