"""Operator 5: shards by extendible hashing.

A directory is indexed by prefixes of a key's hash; only a bucket over the byte
limit splits on another bit. Byte sums of prefixes are pre-aggregated before the
shuffle, a few bits deeper than the data needs, and every prefix's sum follows
from those sums alone. Buckets that are too large even there go on with
their own rows only; rows that share a whole hash (a hot key) split on the bits
of a number of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import cut, documents

SHARD_BYTES = 1 << 20
#: Bits of a hash, and how many more than log2(bytes / limit) a round looks at.
BITS = 60
SLACK_BITS = 5


def hash_bits(key: Column) -> Column:
    """BITS leading bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def prefix_text(value: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.lpad(F.bin(value), depth, F.lit("0"))).otherwise("")


def split_round(rows: DataFrame, bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards that ``bits`` bits of hash_ settle (with their rows), and the rows of prefixes that stay too large."""
    leaves = rows.groupBy("top_", F.shiftright("hash_", BITS - bits).alias("leaf_")).agg(F.sum("n_bytes").alias("b_"), F.count(F.lit(1)).alias("n_"))
    leaves = cut(leaves)
    levels = leaves.select("top_", "leaf_", "b_", "n_", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d_"))
    levels = levels.withColumn("q_", F.expr(f"shiftright(leaf_, {bits} - d_)"))
    nodes = levels.groupBy("top_", "d_", "q_").agg(F.sum("b_").alias("b_"), F.sum("n_").alias("n_"))
    fits = (F.col("b_") <= limit) | (F.col("n_") == 1)
    # A prefix is a shard if it fits and its parent, the sum of the two children, doesn't.
    parents = nodes.withColumn("fits_", fits).select("top_", (F.col("d_") + 1).alias("d_"), F.col("q_").alias("p_"), F.col("fits_").alias("above_"))
    own = nodes.filter(fits).withColumn("p_", F.shiftright("q_", 1))
    shards = own.join(parents, ["top_", "d_", "p_"], "left").filter("d_ = 0 OR NOT above_").select("top_", "d_", "q_", F.col("b_").alias("shard_bytes"))
    directory = levels.select("top_", "leaf_", "d_", "q_").join(shards, ["top_", "d_", "q_"])
    placed = rows.withColumn("leaf_", F.shiftright("hash_", BITS - bits)).join(directory, ["top_", "leaf_"], "left")
    return placed.filter("d_ IS NOT NULL"), placed.filter("d_ IS NULL").select(*rows.columns)


def extendible_shards(df: DataFrame, key_col: str = "doc_id", bytes_of: Column | None = None, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of df: the key, n_bytes, shard (hash bits as text), depth and shard_bytes.

    Every shard's bytes are within the limit, but for a single row that is
    larger by itself. Null keys hash as empty; repeated rows lie in one shard
    while it fits. An empty table gives no rows. Depths over BITS count bits of
    the rows' own numbers.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) if bytes_of is None else bytes_of
    rows = df.select(F.col(key_col).alias("key_"), size.cast("long").alias("n_bytes"), hash_bits(F.coalesce(F.col(key_col).cast("string"), F.lit(""))).alias("hash_"))
    rows = cut(rows.withColumn("row_", F.monotonically_increasing_id()).withColumn("top_", F.lit("")))
    done, open_rows, base = None, rows, 0
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    while True:
        placed, rest = split_round(open_rows, bits, limit)
        out = placed.select(
            "key_", "n_bytes", F.concat("top_", prefix_text(F.col("q_"), F.col("d_"))).alias("shard"), (F.col("d_") + base).alias("depth"), "shard_bytes"
        )
        done = out if done is None else done.unionByName(out)
        rest = cut(rest)
        if rest.isEmpty():
            break
        if bits < BITS:
            bits = min(BITS, bits + 2 * SLACK_BITS)
            open_rows = rest
        else:  # one key's rows: go on with the bits of their own numbers
            base += BITS
            whole = F.concat("top_", prefix_text(F.col("hash_"), F.lit(BITS)))
            open_rows = rest.withColumn("top_", whole).withColumn("hash_", hash_bits(F.concat_ws(":", F.col("row_").cast("string"), F.lit(base).cast("string"))))
            bits = 2 * SLACK_BITS
    return done.withColumnRenamed("key_", key_col)


def write_shards(df: DataFrame, shards: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """df as Parquet, a folder for each shard. Keys have to be unique."""
    df.join(shards.select(key_col, "shard"), key_col).repartition("shard").write.partitionBy("shard").parquet(path)


def op5_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(documents(spark, sf_dir))


OP5_SQL = f"""
WITH k AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT doc_id, n_bytes, h, d, h >> ({BITS} - d) AS q FROM k, range(0, {BITS + 1}) AS r(d)),
nodes AS (SELECT d, q, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM levels GROUP BY d, q),
fit AS (
  SELECT doc_id, n_bytes, h, d, b, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k
  FROM levels JOIN nodes USING (d, q) WHERE b <= {SHARD_BYTES} OR n = 1)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE substr(lpad(bin(h), {BITS}, '0'), 1, CAST(d AS INTEGER)) END AS shard,
       CAST(d AS INTEGER) AS depth, b AS shard_bytes
FROM fit WHERE k = 1
"""
