import numpy as np

from wardspan.operators import evaluate, models, scoring


def scores(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(s), int(y)) for i, (s, y) in enumerate(zip(np.round(rng.random(300), 2), rng.random(300) < 0.2))]
    return rows, spark.createDataFrame(rows, "id int, score double, label int")


def test_auroc_is_the_share_of_ordered_pairs(spark):
    rows, df = scores(spark)
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(evaluate.auroc(df).first()[0] - expected) < 1e-9


def test_best_f1(spark):
    rows, df = scores(spark)
    def f1(t):
        tp = sum(1 for _, s, y in rows if s >= t and y)
        return 2 * tp / (sum(1 for _, s, _ in rows if s >= t) + sum(y for _, _, y in rows))
    assert abs(evaluate.best_f1(df).first()["f1"] - max(f1(s) for _, s, _ in rows)) < 1e-9


def test_autoencoder_and_trees_find_the_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 1)) @ np.ones((1, 4)) + rng.normal(scale=0.1, size=(300, 4))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(1000, 3.0, -3.0, 3.0, -3.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    model = models.fit_autoencoder(df.filter("id < 1000"), list("abcd"), "id", hidden=(3, 1))
    top = models.autoencoder_score(df, model).orderBy("error", ascending=False).first()
    assert top["id"] == 1000 and top["score"] == 1.0
    assert models.isolation_score(df, list("abcd"), "id", 50).orderBy("if_score", ascending=False).first()["id"] == 1000


def test_folds_are_stratified(spark):
    _, df = scores(spark)
    counts = models.folds(df, 5, "label", "id").groupBy("label", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["label"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_peer_ratio_and_scaling_guard_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0), ("c", 2, 4.0)], "user string, peer_group int, x double")
    got = {r["user"]: r["x_peer_ratio"] for r in scoring.peer_ratios(df, ["x"]).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0}
    same = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "user string, x double")
    assert {r["x_z"] for r in scoring.standard_scale(same, ["x"]).collect()} == {0.0}
    assert {r["s"] for r in scoring.min_max(same, "x", "s").collect()} == {0.0}


def test_saved_models_score_alike(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(100, 3)))], "id int, a double, b double, c double")
    model = models.fit_autoencoder(df, list("abc"), "id", hidden=(2,))
    models.save_model(spark, model, str(tmp_path / "m"))
    score = lambda m: {r["id"]: round(r["score"], 9) for r in models.autoencoder_score(df, m).collect()}
    assert score(models.load_model(spark, str(tmp_path / "m"))) == score(model)


def test_thresholds_without_labels(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.9,)], "score double")
    got = evaluate.thresholds(df).first()
    assert got["medium"] < got["high"] <= 1


def test_calibration_takes_every_held_out_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, i // 40, *map(float, r)) for i, r in enumerate(rng.normal(size=(800, 3)))], "id int, day int, a double, b double, c double")
    monkeypatch.setattr(models, "FIT_ROWS", 200)
    model = models.fit_autoencoder(df, list("abc"), "id", hidden=(2,), time="day")
    whole = models.autoencoder_score(df.filter("day >= 16"), model).toPandas()["error"]
    again = models.calibrate(df.filter("day >= 16"), model)
    assert abs(again["lo"] - np.percentile(whole, 5)) < 1e-4 and abs(again["hi"] - 2 * np.percentile(whole, 95)) < 1e-3
    monkeypatch.setattr(models, "FIT_ROWS", 10_000)
    model = models.fit_autoencoder(df, list("abc"), "id", hidden=(2,))
    errors = models.autoencoder_score(df.withColumn("h", models.F.xxhash64(models.F.lit(43), "id")), model).orderBy("h").toPandas()["error"][640:]
    assert abs(model["lo"] - np.percentile(errors, 5)) < 1e-4 and abs(model["hi"] - 2 * np.percentile(errors, 95)) < 1e-3


def test_trees_of_nothing_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (2, 1.0, None), (3, 9.0, 9.0)], "id int, a double, b double")
    got = models.isolation_score(df, ["a", "b"], "id", 20).toPandas()
    assert len(got) == 4 and got["if_score"].between(0, 1).all()
    assert set(models.isolation_score(df, ["a", "b"], "id", 20, df["id"] > 9).toPandas()["if_score"]) == {0.0}


def test_flagged_share_against_plain_counts(spark):
    rows, df = scores(spark)
    values, labels = np.array([s for _, s, _ in rows]), np.array([y for *_, y in rows])
    for r in evaluate.flagged_share(df, "score", "label", [0.02, 0.1, 0.3]).collect():
        up = values >= np.quantile(values, 1 - r["share"])
        tp = int(labels[up].sum())
        assert r["n_flagged"] == up.sum() and abs(r["f1"] - 2 * tp / (up.sum() + labels.sum())) < 1e-12
