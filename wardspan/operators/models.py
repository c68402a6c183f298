"""Models: peer groups, reconstruction error, isolation trees, stacking, boosted trees, folds.

Networks are fitted on all rows and trees on a bounded sample (``FIT_ROWS``, by a
hash of the key), both in the tasks. Calibration and scoring run on all rows with
the model broadcast, whose size doesn't depend on the data.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardspan.functions import times
from wardspan.operators import networks, ranges
from wardspan.operators.cuts import cut

#: Rows at most that isolation trees are drawn from, and that one of them sees.
FIT_ROWS = 20_000
TREE_ROWS = 256
#: A label's rows are numbered in 2 ** FOLD_BITS parts.
FOLD_BITS = 10


def sample(df: DataFrame, key: str, rows: int = FIT_ROWS, seed: int = 42) -> DataFrame:
    """About ``rows`` rows of df at most, chosen by a hash of the key; fewer rows stay as they are."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < (rows << 20) // n)


def kmeans_peers(df: DataFrame, columns: list[str], k: int, normal: Column | None = None, seed: int = 42) -> DataFrame:
    """peer_group of each row, by K-means on columns scaled with the means and population deviations of normal rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    fit_on = df if normal is None else df.filter(normal)
    totals = fit_on.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [((F.col(c) - F.lit(float(totals[f"{c}_m"] or 0))) / F.lit(float(totals[f"{c}_s"] or 0) or 1.0)).alias(f"{c}_scaled") for c in columns]
    rows = VectorAssembler(inputCols=[f"{c}_scaled" for c in columns], outputCol="vector_", handleInvalid="keep").transform(df.select("*", *scaled))
    model = KMeans(k=k, seed=seed, featuresCol="vector_", predictionCol="peer_group").fit(rows if normal is None else rows.filter(normal))
    return model.transform(rows).select(*df.columns, "peer_group")


def fit_autoencoder(
    df: DataFrame, columns: list[str], key: str, normal: Column | None = None, hidden: tuple[int, ...] | None = None, seed: int = 42, time: str | None = None, plan: networks.Plan | None = None
) -> dict:
    """A network of the normal rows with its scaling and calibration: lo is the 5th, hi twice the 95th percentile of held-out errors.

    The last fifth is held out: by time (dates, times or numbers of days) where there is one,
    so that later rows check earlier ones, else by a hash of the key. All rows are
    fitted on, in the tasks (networks.fit()), scaled by means and population
    deviations of the earlier ones. The layers are those of ``plan``, or of widths
    ``hidden``, or the published ones for so many columns.
    """
    draw = F.xxhash64(F.lit(seed + 1), F.col(key))
    place = draw / float(1 << 64) + 0.5
    if time:
        kind = dict(df.dtypes)[time]
        place += F.unix_date(time) if kind == "date" else times.micros(df, time) / 8.64e10 if kind.startswith("timestamp") else F.col(time).cast("double")
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    rows = cut((df if normal is None else df.filter(normal)).select(draw.alias("draw"), place.cast("double").alias("place"), values.alias("v"), key, *[c for c in columns if c != key]))
    n, found = ranges.at_ranks(rows, {"place": lambda n: [max(1, int(n * 0.8))] if n > 1 else []})["place"]
    bound = next(iter(found.values()), None)
    early = F.lit(True) if bound is None else F.col("place") < F.lit(bound)
    told = rows.filter(early).agg(*[f(F.col("v")[i]).alias(f"{m}{i}") for i in range(len(columns)) for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, spread = np.array([told[f"m{i}"] or 0.0 for i in range(len(columns))]), np.array([told[f"s{i}"] or 1.0 for i in range(len(columns))])
    scaled = F.array(*[(F.col("v")[i] - F.lit(float(m))) / F.lit(float(s)) for i, (m, s) in enumerate(zip(mean, spread))])
    plan = plan or (networks.mirrored_plan(len(columns), hidden) if hidden else networks.cloud_plan(len(columns)) if len(columns) <= 32 else networks.endpoint_plan(len(columns)))
    net = networks.fit(rows.select(scaled.alias("x"), early.alias("is_train"), "draw"), len(columns), plan, n, seed)
    model = {"net": net, "mean": mean, "spread": spread, "columns": columns, "lo": 0.0, "hi": 0.0}
    return model | calibrate(rows if bound is None else rows.filter(~early), model)


def calibrate(df: DataFrame, model: dict) -> dict:
    """lo and hi (the 5th and twice the 95th percentile) of a network's errors on all rows of df; 0 without rows."""
    lo, high = ranges.quantiles(autoencoder_score(df, model).select("error"), {"error": [0.05, 0.95]})["error"]
    return {"lo": lo or 0.0, "hi": 2 * (high or 0.0)}


def autoencoder_score(df: DataFrame, model: dict) -> DataFrame:
    """error, residuals and score (0 to 1) of each row; a row of zeros has no score."""
    shared, columns = df.sparkSession.sparkContext.broadcast(model), model["columns"]

    @F.pandas_udf("struct<error double, residuals array<double>>")
    def run(values: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        x = (values.fillna(0).to_numpy(float) - m["mean"]) / m["spread"]
        r = m["net"].residuals(x)
        return pd.DataFrame({"error": np.mean(r**2, axis=1), "residuals": list(r)})

    found = df.withColumn("ae_", run(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))
    wide = max(model["hi"] - model["lo"], 1e-12)
    zero = F.forall(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]), lambda v: v == 0)
    score = F.when(~zero, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("ae_.error") - model["lo"]) / wide)))
    return found.withColumns({"error": F.col("ae_.error"), "residuals": F.col("ae_.residuals"), "score": score}).drop("ae_")


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """A fitted network with scaling and calibration as one JSON text under path; its size is that of the weights."""
    kept = {k: np.asarray(v).tolist() if k in ("mean", "spread") else v for k, v in model.items()} | {"net": networks.as_dict(model["net"])}
    spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    """What save_model() has written, ready for autoencoder_score()."""
    kept = json.loads(spark.read.text(path).first()["value"])
    return kept | {"net": networks.from_dict(kept["net"]), "mean": np.array(kept["mean"]), "spread": np.array(kept["spread"])}


def path_adjust(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """An isolation tree as a table of its nodes: column (-1 in a leaf), cut, the numbers of the left and the right node, and a leaf's depth with its adjustment."""
    limit = max(1, int(np.ceil(np.log2(max(len(x), 2)))))
    nodes: dict[str, list] = {"column": [], "cut": [], "left": [], "right": [], "depth": []}
    todo = [(np.arange(len(x)), 0, None)]
    while todo:
        rows, depth, parent = todo.pop()
        if parent:
            nodes[parent[0]][parent[1]] = len(nodes["column"])
        spans = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(0)
        usable = np.flatnonzero(spans > 0)
        leaf = depth >= limit or len(rows) <= 1 or not len(usable)
        c = -1 if leaf else int(rng.choice(usable))
        cut = 0.0 if leaf else float(rng.uniform(x[rows, c].min(), x[rows, c].max()))
        at = len(nodes["column"])
        for name, value in (("column", c), ("cut", cut), ("left", 0), ("right", 0), ("depth", depth + float(path_adjust(len(rows))) if leaf else 0.0)):
            nodes[name].append(value)
        if not leaf:
            below = x[rows, c] < cut
            todo += [(rows[~below], depth + 1, ("right", at)), (rows[below], depth + 1, ("left", at))]
    return nodes


def depths(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The depth of the leaf that each row comes to."""
    at, column = np.zeros(len(x), np.int64), nodes["column"]
    inner = np.flatnonzero(column[at] >= 0)
    while len(inner):
        here = at[inner]
        at[inner] = np.where(x[inner, column[here]] < nodes["cut"][here], nodes["left"][here], nodes["right"][here])
        inner = inner[column[at[inner]] >= 0]
    return nodes["depth"][at]


def isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 500, share: float = 1.0, seed: int = 42) -> DataFrame:
    """A table of isolation trees (tree, used, size, column, cut, left, right, depth), a row for each, grown in the tasks.

    Each tree has TREE_ROWS rows of its own by a hash of its number and the key,
    and a share of the columns; rows are drawn from a bounded sample. Nulls count
    as 0. Without rows there are no trees.
    """
    drawn = cut(sample(df, key, seed=seed).select(F.col(key).cast("string").alias("key_"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}_") for i, c in enumerate(columns)]))
    n, width = drawn.count(), max(1, int(len(columns) * share))
    draw = F.xxhash64(F.lit(seed), "tree", "key_")
    some = 2.0 * min(1.0, 1.5 * TREE_ROWS / max(n, 1)) - 1.0  # of hashes from -1 to 1; the surplus goes in the group
    rows = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("draw_", draw).filter(F.col("draw_") / float(1 << 63) <= some)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, key[0]])
        x = rows.sort_values(["draw_", "key_"]).head(TREE_ROWS)[names].to_numpy(float)
        used = np.sort(rng.choice(len(columns), width, replace=False))
        return pd.DataFrame({"tree": [key[0]], "used": [used.tolist()], "size": [len(x)]} | {k: [v] for k, v in grow(x[:, used], rng).items()})

    names = [f"x{i}_" for i in range(len(columns))]
    return rows.groupBy("tree").applyInPandas(run, "tree int, used array<int>, size int, column array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>")


def isolation_apply(df: DataFrame, forest: DataFrame, columns: list[str]) -> DataFrame:
    """if_score of each row (larger: easier to isolate) by a table of trees, whose size is bounded by their number; 0 without trees."""
    kept = [{"used": np.array(r["used"]), "size": r["size"]} | {k: np.array(r[k]) for k in ("column", "cut", "left", "right", "depth")} for r in forest.collect()]
    shared = df.sparkSession.sparkContext.broadcast(kept)
    usual = float(np.mean([path_adjust(t["size"]) for t in kept])) if kept else 1.0

    @F.pandas_udf("double")
    def run(values: pd.DataFrame) -> pd.Series:
        x = values.fillna(0).to_numpy(float)
        total = np.zeros(len(x))
        for tree in shared.value:
            total += depths(tree, x[:, tree["used"]])
        return pd.Series(2.0 ** (-total / len(shared.value) / (usual or 1.0)) if shared.value else total)

    return df.withColumn("if_score", run(F.struct(*[F.col(c).cast("double").alias(f"x{i}_") for i, c in enumerate(columns)])))


def isolation_score(df: DataFrame, columns: list[str], key: str, trees: int = 500, normal: Column | None = None, share: float = 1.0, seed: int = 42) -> DataFrame:
    """if_score of each row by isolation_forest() of the normal rows."""
    df = cut(df)
    return isolation_apply(df, isolation_forest(df if normal is None else df.filter(normal), columns, key, trees, share, seed), columns)


def contamination_cuts(df: DataFrame, score: str, shares: list[float], normal: Column | None = None) -> dict[float, float | None]:
    """For each share of contamination the score that so many of the (normal) rows lie over, exactly."""
    rows = df if normal is None else df.filter(normal)
    return dict(zip(shares, ranges.quantiles(rows, {score: [1 - s for s in shares]})[score]))


def folds(df: DataFrame, k: int, label: str, key: str) -> DataFrame:
    """fold 0 to k-1, stratified by label: places in the order of a hash of the key, modulo k.

    Rows are numbered in parts of a label by the hash, and each part goes on from
    the rows of the parts before it, so a label with most rows is many tasks.
    """
    h = F.xxhash64(F.lit("fold"), F.col(key))
    dealt = df.withColumns({"h_": h, "part_": F.shiftright(h, 64 - FOLD_BITS)})
    sizes = dealt.groupBy(label, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(W.partitionBy(label).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col(label).alias("label_"), F.col("part_").alias("of_"), F.coalesce(before, F.lit(0)).alias("before_"))
    place = F.row_number().over(W.partitionBy(label, "part_").orderBy("h_", key))
    told = dealt.withColumn("place_", place).join(sizes, F.col(label).eqNullSafe(F.col("label_")) & (F.col("part_") == F.col("of_")))
    return told.withColumn("fold", (F.col("before_") + F.col("place_") - 1) % k).select(*df.columns, "fold")


def kfold_scores(df: DataFrame, columns: list[str], key: str, label: str, k: int = 5, hidden: tuple[int, ...] | None = None, plan: networks.Plan | None = None) -> DataFrame:
    """Reconstruction scores of each fold by a network of the other folds' normal rows."""
    told, out = cut(folds(df, k, label, key)), None
    for i in range(k):
        model = fit_autoencoder(told, columns, key, (F.col("fold") != i) & (F.col(label) == 0), hidden, plan=plan)
        part = autoencoder_score(told.filter(F.col("fold") == i), model).select(key, label, "fold", "error", "score")
        out = part if out is None else out.unionByName(part)
    return out


def balanced(df: DataFrame, label: str) -> Column:
    """A weight that gives both labels of df the same sum: all rows over twice a label's."""
    sizes = {r[label]: r["count"] for r in df.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    weight = F.lit(1.0)
    for value, n in sizes.items():
        weight = F.when(F.col(label) == value, sum(sizes.values()) / (2.0 * n)).otherwise(weight)
    return weight


def stacked(df: DataFrame, columns: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """stack_score by logistic regression on score columns with balanced labels, each fold by a model of the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    told, out = cut(folds(df, k, label, key)), None
    told = VectorAssembler(inputCols=columns, outputCol="vector_", handleInvalid="keep").transform(told)
    for i in range(k):
        rest = told.filter(F.col("fold") != i)
        model = LogisticRegression(featuresCol="vector_", labelCol=label, weightCol="weight_", maxIter=50).fit(rest.withColumn("weight_", balanced(rest, label)))
        part = model.transform(told.filter(F.col("fold") == i)).withColumn("stack_score", vector_to_array("probability")[1]).select(*df.columns, "fold", "stack_score")
        out = part if out is None else out.unionByName(part)
    return out


def pseudo_labels(df: DataFrame, score: str, high: float = 0.92, low: float = 0.30) -> DataFrame:
    """pseudo: 1 from the high quantile of a score on, 0 up to the low one, null between; where both are one value, 0."""
    top, bottom = ranges.quantiles(df, {score: [high, low]})[score]
    return df.withColumn("pseudo", F.when(F.col(score) <= F.lit(bottom).cast("double"), 0).when(F.col(score) >= F.lit(top).cast("double"), 1))


def boosted(df: DataFrame, columns: list[str], score: str, rounds: int = 200, depth: int = 6, step: float = 0.05, seed: int = 42) -> DataFrame:
    """boost_score of each row: boosted trees on columns, fitted on the pseudo-labels of a score with balanced weights.

    Nulls count as 0. Where the score has one value only there is nothing to
    learn, and boost_score is the score, as without the library of trees.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    told = pseudo_labels(cut(df), score)
    fit_on = told.filter(F.col("pseudo").isNotNull())
    if fit_on.select("pseudo").distinct().count() < 2:
        return told.withColumn("boost_score", F.col(score)).select(*df.columns, "pseudo", "boost_score")
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}_") for i, c in enumerate(columns)]
    vectors = VectorAssembler(inputCols=[f"x{i}_" for i in range(len(columns))], outputCol="vector_")
    model = GBTClassifier(featuresCol="vector_", labelCol="pseudo", weightCol="weight_", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    fitted = model.fit(vectors.transform(fit_on.select("pseudo", balanced(fit_on, "pseudo").alias("weight_"), *filled)))
    return fitted.transform(vectors.transform(told.select("*", *filled))).withColumn("boost_score", vector_to_array("probability")[1]).select(*df.columns, "pseudo", "boost_score")
