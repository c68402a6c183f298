import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspan.operators import models, networks
from wardspan.operators.networks import Layer, Network, Plan, State
from wardspan.plans import scores


def small_plan(**kw):
    return Plan([Layer(5, norm=True), Layer(3), Layer(4, leaky=False)], **kw)


def test_gradients_against_small_steps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4))
    net = Network.new(4, small_plan(), 3)
    found = net.gradients(x, rng)

    def loss(vector):
        trial = Network.new(4, small_plan())
        trial.put(vector)
        out = x
        for layer, p in zip(trial.plan.layers, trial.layers):
            out = out @ p["w"] + p["b"]
            if layer.norm:
                out = (out - out.mean(axis=0)) / np.sqrt(out.var(axis=0) + networks.EPSILON) * p["scale"] + p["shift"]
            if layer.leaky:
                out = np.where(out > 0, out, networks.SLOPE * out)
        return np.mean((out - x) ** 2)

    vector, at = net.vector(), 0
    for i, p in enumerate(net.layers):
        for k in p:
            if k not in ("mean", "var"):
                for j in range(0, p[k].size, 3):
                    step = np.zeros_like(vector)
                    step[at + j] = 1e-6
                    assert (loss(vector + step) - loss(vector - step)) / 2e-6 == pytest.approx(found[i, k].ravel()[j], abs=1e-7)
            at += p[k].size


def made(spark, n=400, d=4):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, d)) + rng.normal(scale=0.05, size=(n, d))
    rows = [(x[i].tolist(), i % 5 > 0, int(rng.integers(-(2**62), 2**62))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "x array<double>, is_train boolean, draw long").repartition(6)


def test_one_task_is_a_plain_fit(spark):
    rows, df = made(spark)
    plan = small_plan(epochs=15, rate=1e-2)
    net = networks.fit(df, 4, plan, len(rows))
    rows.sort(key=lambda r: r[2])
    new = Network.new(4, plan, 42)
    size = sum(new.layers[i][k].size for i, k in new.trained())
    state = networks.train(4, plan, State(new.vector(), np.zeros(size), np.zeros(size)), np.array([x for x, t, _ in rows if t]), np.array([x for x, t, _ in rows if not t]), 15, 42)
    assert np.allclose(net.vector(), state.vector, atol=1e-12)


def test_many_tasks_learn_as_well(spark, monkeypatch):
    rows, df = made(spark, 2000)
    plan = Plan([Layer(8), Layer(2), Layer(8), Layer(4, leaky=False)], epochs=60, rate=1e-2, decay=0.0)
    x = np.array([r[0] for r in rows])
    loss = lambda net: np.mean(net.residuals(x) ** 2) / x.var()
    one = loss(networks.fit(df, 4, plan, len(rows)))
    monkeypatch.setattr(networks, "TASK_ROWS", 500)
    several = loss(networks.fit(df, 4, plan, len(rows)))
    assert one < 0.2 and several < 0.25


def test_published_widths_dropout_and_saving():
    net = Network.new(71, networks.endpoint_plan(71))
    assert [p["w"].shape for p in net.layers] == [(71, 128), (128, 64), (64, 32), (32, 16), (16, 32), (32, 64), (64, 128), (128, 71)]
    assert [layer.drop for layer in net.plan.layers] == [0.3, 0.2, 0, 0, 0, 0.2, 0, 0] and ["scale" in p for p in net.layers] == [True, True, True, False, False, True, True, False]
    assert [p["w"].shape[1] for p in Network.new(12, networks.cloud_plan(12)).layers] == [32, 16, 8, 16, 32, 12]
    x = np.random.default_rng(1).normal(size=(64, 71))
    net.gradients(x, np.random.default_rng(2))
    assert not np.allclose(net.layers[0]["mean"], 0)
    again = networks.from_dict(networks.as_dict(net))
    assert np.allclose(again.apply(x), net.apply(x))


def test_nothing_and_one_row(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    for rows in (df, df.limit(0)):
        model = models.fit_autoencoder(rows, ["a", "b"], "id", hidden=(2,))
        assert models.autoencoder_score(df, model).count() == 1


def test_forest_like_a_plain_one(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(900, 3)), rng.normal(4, 2, size=(30, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").repartition(5)
    forest = models.isolation_forest(df, list("abc"), "id", 200)
    assert forest.count() == 200 and forest.agg(F.max("size")).first()[0] == models.TREE_ROWS
    got = models.isolation_apply(df, forest, list("abc")).orderBy("id").toPandas()["if_score"].to_numpy()

    def plain_depth(rows, points, depth):
        """A plain recursive tree, on its own draws."""
        spans = np.ptp(rows, axis=0) if len(rows) else np.zeros(3)
        if depth >= 8 or len(rows) <= 1 or not (spans > 0).any():
            return np.full(len(points), depth + float(models.path_adjust(len(rows))))
        c = rng.choice(np.flatnonzero(spans > 0))
        at = rng.uniform(rows[:, c].min(), rows[:, c].max())
        out, low = np.empty(len(points)), points[:, c] < at
        out[low], out[~low] = plain_depth(rows[rows[:, c] < at], points[low], depth + 1), plain_depth(rows[rows[:, c] >= at], points[~low], depth + 1)
        return out

    plain = np.mean([plain_depth(x[rng.choice(len(x), 256, replace=False)], x, 0) for _ in range(200)], axis=0)
    want = 2.0 ** (-plain / float(models.path_adjust(256)))
    assert np.corrcoef(got, want)[0, 1] > 0.95
    cuts = models.contamination_cuts(spark.createDataFrame([(float(v),) for v in got], "s double"), "s", [0.03, 0.1])
    assert [round(float(np.quantile(got, 1 - k)), 12) for k in cuts] == [round(v, 12) for v in cuts.values()]


def test_pseudo_labels_and_boosting(spark):
    rng = np.random.default_rng(8)
    scores = rng.random(300)
    df = spark.createDataFrame([(i, float(s), float(s + rng.normal(scale=0.05)), None if i % 7 else 1.0) for i, s in enumerate(scores)], "id int, score double, a double, b double")
    top, bottom = np.quantile(scores, 0.92), np.quantile(scores, 0.30)
    got = {r["id"]: r["pseudo"] for r in models.pseudo_labels(df, "score").collect()}
    assert got == {i: 1 if s >= top else 0 if s <= bottom else None for i, s in enumerate(scores)}
    out = models.boosted(df, ["a", "b"], "score", rounds=8, depth=3).toPandas()
    assert out[out.pseudo == 1].boost_score.min() > 0.5 > out[out.pseudo == 0].boost_score.max()
    same = models.boosted(df.withColumn("score", F.lit(0.3)), ["a"], "score", rounds=2)
    assert {(r["pseudo"], r["boost_score"]) for r in same.collect()} == {(0, 0.3)}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "y int")
    sums = {r["y"]: r["w"] for r in df.withColumn("w", models.balanced(df, "y")).groupBy("y").agg(F.sum("w").alias("w")).collect()}
    assert sums == pytest.approx({0: 20.0, 1: 20.0})


def plain_adam(plan, x, epochs, seed):
    """The optimiser parameter by parameter; the last parameters stay."""
    net, rng = Network.new(x.shape[1], plan, 42), np.random.default_rng([seed, 0])
    m = {p: np.zeros_like(net.layers[p[0]][p[1]]) for p in net.trained()}
    v, steps = {p: a.copy() for p, a in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), plan.batch):
            grads = net.gradients(x[order[a : a + plan.batch]], rng)
            norm, steps = np.sqrt(sum((g * g).sum() for g in grads.values())), steps + 1
            for p, g in grads.items():
                w = net.layers[p[0]][p[1]]
                g = g * min(1.0, plan.clip / (norm + 1e-6)) + plan.decay * w
                m[p] += 0.1 * (g - m[p])
                v[p] += 0.001 * (g * g - v[p])
                w -= plan.rate * (m[p] / (1 - 0.9**steps)) / (np.sqrt(v[p] / (1 - 0.999**steps)) + 1e-8)
    return net


def test_one_vector_moves_as_single_parameters_do():
    x, plan = np.random.default_rng(3).normal(size=(100, 4)), small_plan(clip=0.1, batch=16)
    new = Network.new(4, plan, 42)
    size = sum(new.layers[i][k].size for i, k in new.trained())
    for epochs in (1, 2):
        got = networks.train(4, plan, State(new.vector(), np.zeros(size), np.zeros(size)), x, x[:0], epochs, 7)
        want = plain_adam(plan, x, epochs, 7)
        assert np.allclose(got.vector, want.vector(), atol=1e-10) and got.steps == 7 * epochs


def test_rows_of_a_large_table_are_dealt_to_as_many_tasks_as_cores():
    assert 250_000 / networks.TASK_ROWS >= 12


def test_the_query_boosts_in_as_many_rounds_as_published(spark, small, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    fit, told = GBTClassifier.fit, []
    plan = models.networks.endpoint_plan(63)
    monkeypatch.setattr(models.networks, "endpoint_plan", lambda n: Plan(plan.layers, epochs=1))
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: told.append((self.getMaxIter(), self.getMaxDepth(), self.getStepSize())) or fit(self.copy({self.maxIter: 1}), df))
    scores.boosted_score(spark, small)
    assert told == [(200, 6, 0.05)]
