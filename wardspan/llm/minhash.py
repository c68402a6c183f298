"""Operator 6: near-duplicate groups by b-bit MinHash.

A scan makes each document's shingle set and, of the set alone, band keys and a
packed signature of the low bits of its minima. Documents with equal sets become
one representative. Bands give candidate pairs, signatures an estimate corrected
for chance collisions, and full sets the decision.

A band's bucket may hold a third of all rows, so pairs within it are never
listed. Its members are first compared with one pivot. A bucket whose members the
links so far join into one component is done. The others are compared in full, in
blocks: two blocks of BLOCK members meet in one task, unless both lie in the
bucket's largest component. The task compares signatures by bit counts and the
sets of what is left by matrix products, skips pairs of one component, and returns
only links that join two components. So no link is lost, rows stay linear in the
members of a block, and the members that one component already joins cost only
their meetings with the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.base import cut, documents, explode_texts, join_summary, map_texts, release

PERMUTATIONS = 128
#: Low bits of each minimum, and minima in a 64-bit word of the signature.
B = 4
LANES = 64 // B
#: Chance to miss a pair just at the threshold that the bands are chosen for.
MISS = 1e-6
#: Standard deviations below the threshold from which an estimate rules a pair out.
SAFE = 6.0
#: Members of a block, and columns of the matrices that blocks of sets become.
BLOCK = 256
COLUMNS = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_WORD = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most selective bands that miss a pair at the threshold with a chance of at most MISS."""
    fits = [(PERMUTATIONS // r, r) for r in range(1, 17) if (1 - threshold**r) ** (PERMUTATIONS // r) <= MISS]
    return fits[-1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of k words; of a shorter text, of its whole sequence."""
    split = [t.encode().translate(_LOWER).split() for t in texts]
    words = [w for ws in split for w in ws]
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    codes, unique = pd.factorize(np.array(words, object))
    hashed = pd.util.hash_array(np.asarray(unique, object), categorize=False)[codes]
    out, at = [], 0
    for ws in split:
        h = hashed[at : at + len(ws)]
        at += len(ws)
        n = min(k, len(ws))
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        m = len(h) - n + 1
        s = np.full(m, n, np.uint64)
        for i in range(n):
            s += mix(h[i : i + m] ^ _WORD[i]) * _WORD[i]
        out.append(np.unique(mix(s)))
    return out


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set, as signed longs."""
    return int(np.sum(s).view(np.int64)), int(np.sum(mix(s ^ _WORD[63])).view(np.int64))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and packed low bits (int64) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low = np.zeros((len(sets), -(-bands * rows // LANES)), np.uint64)
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((flat ^ _FLIP[i]) * _MULTIPLY[i], starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            low[:, i // LANES] |= (mix(least) & np.uint64((1 << B) - 1)) << np.uint64(B * (i % LANES))
        keys[:, band] = key
    return keys.view(np.int64), low.view(np.int64)


def sign(df: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, two hashes of the whole set, band keys and packed low bits (null for an empty set)."""

    def call(texts):
        sets = shingle_sets(texts, k)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, low = signatures([sets[i] for i in full], bands, rows) if full else (np.zeros((0, bands), np.int64), np.zeros((0, 1), np.int64))
        at = {i: j for j, i in enumerate(full)}
        some = lambda table: pa.array([table[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64()))
        whole = [set_hashes(s) if len(s) else (None, None) for s in sets]
        return {
            "n_shingles": [len(s) for s in sets],
            "set1": pa.array([w[0] for w in whole], pa.int64()),
            "set2": pa.array([w[1] for w in whole], pa.int64()),
            "bands": some(keys),
            "low": some(low),
        }

    return map_texts(df, lambda: call, "n_shingles long, set1 long, set2 long, bands array<long>, low array<long>", id_col, text_col)


def unequal_lanes(a: str, b: str) -> Column:
    """Minima of two signatures whose low bits differ, by bit counts."""
    ones = sum(1 << B * i for i in range(LANES))
    ones -= (ones >> 63) << 64
    folded = "x"
    for s in range(1, B):
        folded = f"({folded} | shiftrightunsigned(x, {s}))"
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (n, x) -> n + bit_count({folded} & {ones}L))")


def least_equal(threshold: float, n: int) -> float:
    """Equal lanes that a pair at the threshold has, less SAFE standard deviations.

    Different minima agree by chance with probability c = 2**-B, so equal lanes
    estimate c + (1 - c) * similarity.
    """
    p = 2.0**-B + (1 - 2.0**-B) * threshold
    return n * p - SAFE * (n * p * (1 - p)) ** 0.5


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the smallest id that it is linked with over any number of edges (a, b).

    Edges are rewritten in turn to hang a vertex's larger and its smaller
    neighbours on its smallest one, until they are stars: the rounds are
    logarithmic in a component's size, also for long chains, and no round holds
    more edges than the first.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not are_stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_summary(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = join_summary(large, down, ["hi"]).filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(down.select("hi", F.col("m").alias("lo")))
        done, edges = edges, cut(small.distinct())
        release(done)
    roots = edges.select(F.col("lo").alias("id")).distinct()
    labels = cut(edges.select(F.col("hi").alias("id"), F.col("lo").alias("comp")).unionByName(roots.select("id", F.col("id").alias("comp"))))
    release(edges)
    return labels


def are_stars(edges: DataFrame) -> bool:
    """Whether every vertex of the edges (hi, lo) is either a root or hangs on one root only."""
    ends = F.explode(F.array(F.struct(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root"))))
    seen = edges.select(ends.alias("e")).groupBy("e.v").agg(F.sum("e.up").alias("up"), F.max("e.root").alias("root"))
    return seen.filter("up > 1 OR up = 1 AND root = 1").isEmpty()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after more links (a, b) between components."""
    if links.isEmpty():
        return labels
    roots = components(links).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    known = labels.unionByName(roots.select(F.col("comp").alias("id"), F.col("comp")).join(labels.select("id"), "id", "left_anti"))
    return known.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))


def joining(low: np.ndarray, sets: list[np.ndarray], comps: list, sides: np.ndarray, lanes: int, threshold: float, least: float) -> list[tuple]:
    """Links between different components of a block's members, as few as join what is linked.

    With two sides, only members of different sides are compared.
    """
    n = len(sets)
    number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([number[c] for c in comps])
    open_ = comp[:, None] != comp[None, :]
    if (sides != sides[0]).any():
        open_ &= sides[:, None] != sides[None, :]
    ones = np.uint64(sum(1 << B * i for i in range(LANES)))
    unequal = np.zeros((n, n), np.int64)
    for w in range(low.shape[1]):
        x = low[:, None, w] ^ low[None, :, w]
        folded = x.copy()
        for i in range(1, B):
            folded |= x >> np.uint64(i)
        unequal += np.bitwise_count(folded & ones)
    open_ &= lanes - unequal >= least
    rows = np.flatnonzero(open_.any(axis=1))
    if not len(rows):
        return []
    sizes = np.array([len(sets[i]) for i in rows])
    _, column, times = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    several = times[column] > 1
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(rows), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - start] = 1
        both += part @ part.T
    percent = round(100 * threshold)
    linked = open_[np.ix_(rows, rows)] & (100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64)))
    out, now = [], comp[rows].copy()
    for i in range(len(rows)):
        for j in np.flatnonzero(linked[i]):
            if now[i] != now[j]:
                out.append((comps[rows[i]], comps[rows[j]]))
                now[now == now[j]] = now[i]
    return out


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """Buckets of (key, id, comp) whose members lie in several components: n members, and ``of`` with the key and the largest component ``top``.

    Buckets of several bands with the same members count once: those of equal
    number and of two equal independent 64-bit fingerprints of their members.
    """
    prints = [F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("h2")]
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), *prints)
    whole = [F.bit_xor(h).alias(h) for h in ("h1", "h2")]
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), *whole, F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "comp")).alias("top")).filter("parts > 1")
    return mixed.groupBy("n", "h1", "h2").agg(F.min(F.struct("key", "top")).alias("of"))


def block_links(shared: DataFrame, labels: DataFrame, signed: DataFrame, sets: DataFrame, lanes: int, threshold: float, least: float) -> DataFrame:
    """Links (a, b) between components by comparing, in blocks, the members of buckets (key, id) that lie in several."""
    placed = shared.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = mixed_buckets(placed)
    # The largest component of a bucket has blocks of its own, which never meet each other.
    large = F.col("n") > BLOCK
    mixed = mixed.select(
        F.col("of.key").alias("key"),
        F.col("of.top.comp").alias("top"),
        F.when(large, F.ceil(F.col("of.top.n") / BLOCK)).otherwise(0).cast("int").alias("first"),
        F.when(large, F.ceil((F.col("n") - F.col("of.top.n")) / BLOCK)).otherwise(1).cast("int").alias("rest"),
    )
    inner, dealt = (F.col("first") > 0) & (F.col("comp") == F.col("top")), F.xxhash64("id", "key")
    own = F.when(inner, F.pmod(dealt, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(dealt, F.col("rest"))).cast("int")
    meets = F.sequence(F.when(inner, F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)
    open_ = placed.join(mixed, "key").select("key", "id", "comp", own.alias("own"), meets.alias("meets"))
    whole = open_.join(signed, "id").join(sets, "id").withColumn("other", F.explode("meets"))
    ordered = whole.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", "low", "shingles")
    ordered = ordered.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    kind = dict(labels.dtypes)["comp"]

    def run(batches):
        held, at = [], None

        def finish():
            if len({m[1] for m in held}) < 2:
                return None
            found = joining(np.stack([m[2] for m in held]), [m[3] for m in held], [m[1] for m in held], np.array([m[0] for m in held]), lanes, threshold, least)
            return pa.RecordBatch.from_arrays([pa.array(x, id_type) for x in zip(*((min(p), max(p)) for p in found))], names=["a", "b"]) if found else None

        for batch in batches:
            id_type = batch.schema.field(4).type
            low, shingles = batch.column(5), batch.column(6)
            for r, (key, i, j, own, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (key, i, j) != at:
                    if held and (out := finish()):
                        yield out
                    held, at = [], (key, i, j)
                as_words = lambda a: a.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                held.append((own, comp, as_words(low[r]), as_words(shingles[r])))
        if held and (out := finish()):
            yield out

    return ordered.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_groups(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of k-word shingles; component_id is the smallest id reachable. Null and
    empty texts have no shingles and no links, nor have null ids. Rows with one
    id share a component, and each of their texts links on its own; all of them
    are kept or none. An empty table gives no rows.
    """
    bands, rows = bands_for(percent / 100)
    signed = cut(sign(df, k, bands, rows, id_col, text_col).withColumnRenamed(id_col, "doc"))
    keyed = signed.filter("set1 IS NOT NULL AND doc IS NOT NULL")
    # From here on an id is the number of a set: documents that share one become one representative.
    leaders = keyed.groupBy("set1", "set2").agg(F.min_by(F.struct("doc", "bands", "low"), "doc").alias("first"))
    leaders = cut(leaders.select(F.monotonically_increasing_id().alias("id"), "set1", "set2", "first.*"))
    members = join_summary(keyed.select("doc", "set1", "set2"), leaders.select("id", "set1", "set2"), ["set1", "set2"]).select("doc", "id").distinct()

    spread = leaders.select("id", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(join_summary(spread, shared.select("key", "pivot"), ["key"]))
    wanted = leaders.join(shared.select("id").distinct(), "id", "left_semi").select("doc", "id", "set1", "set2")
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(wanted.select("doc").distinct(), "doc", "left_semi")

    def as_sets(docs, found):
        sets = shingle_sets(found, k)
        set1, set2 = zip(*map(set_hashes, sets))
        return {"set1": pa.array(set1, pa.int64()), "set2": pa.array(set2, pa.int64()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}

    made = explode_texts(texts, lambda: as_sets, "set1 long, set2 long, shingles array<long>", "doc", "text")
    sets = cut(made.join(wanted.select("id", "set1", "set2"), ["set1", "set2"]).dropDuplicates(["set1", "set2"]).select("id", "shingles"))
    lanes = leaders.select("id", "low")
    least = least_equal(percent / 100, bands * rows)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the estimate doesn't rule out and the full sets confirm."""
        by = lambda table, name: table.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in table.columns if c != "id"])
        likely = pairs.join(by(lanes, "a"), "a").join(by(lanes, "b"), "b").filter(bands * rows - unequal_lanes("low_a", "low_b") >= F.lit(least)).select("a", "b")
        full = likely.join(by(sets, "a"), "a").join(by(sets, "b"), "b")
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return full.filter(100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b")

    star = shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    # Sets that stand under one id are linked by it.
    one_id = members.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").select("doc", "a")
    links = cut(linked(star).unionByName(members.join(one_id, "doc").filter("id <> a").select("a", F.col("id").alias("b"))))
    labels = components(links)
    release(links)
    more = cut(block_links(shared, labels, lanes, sets, bands * rows, percent / 100, least))
    release(shared, sets)
    labels = relabelled(labels, more)

    placed = members.join(labels, "id", "left").select("doc", F.coalesce("comp", "id").alias("comp")).distinct()
    smallest = placed.groupBy("comp").agg(F.min("doc").alias("least"))
    told = join_summary(placed, smallest, ["comp"]).select("doc", F.col("least").alias("component_id"))
    return signed.select("doc", "n_shingles").join(told, "doc", "left").select(
        F.col("doc").alias(id_col),
        "n_shingles",
        F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce("component_id", "doc").eqNullSafe(F.col("doc")).alias("kept"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), 3, 85)


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (m + n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
