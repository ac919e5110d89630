import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from commitloom.ml import evaluate, features, models, network, windows


def test_windows_are_disjoint_and_adjacent(spark):
    plan = windows.plan(spark, 1000, 300, 100, 5, seed=1, ignore=0.1).collect()
    assert len(plan) == 5 and all(r.train_to == r.test_from and r.test_to <= 900 and r.train_to - r.train_from == 300 and r.train_from >= 0 for r in plan)
    assert windows.plan(spark, 10, 5, 50, 3).count() == 0
    rows = spark.range(1000).select(F.col("id").alias("row_id"))
    sizes = {(r.iter, r.part): r["count"] for r in windows.assign(rows, windows.plan(spark, 1000, 300, 100, 2, seed=2)).groupBy("iter", "part").count().collect()}
    assert sizes == {(0, "train"): 300, (0, "test"): 100, (1, "train"): 300, (1, "test"): 100}


def test_features_roundtrip(spark):
    df = spark.createDataFrame([("a", 1.0, "x", ["f", "g"]), ("b", 3.0, "y", None), ("c", None, None, [])], "cid string, n double, k string, fs array<string>")
    long = features.to_long(df, "cid", {"n": F.col("n")}, {"k": F.col("k")}, {"has": F.col("fs")})
    assert {(r.cid, r.feature, r.value) for r in long.collect()} == {("a", "n", 1.0), ("a", "k=x", 1.0), ("a", "has_f", 1.0), ("a", "has_g", 1.0), ("b", "n", 3.0), ("b", "k=y", 1.0)}
    fitted = features.fit(long, 3)
    assert [(r.feature, r.lo, r.hi) for r in fitted.orderBy("index").collect()] == [("has_f", 0.0, 1.0), ("has_g", 0.0, 1.0), ("k=x", 0.0, 1.0), ("k=y", 0.0, 1.0), ("n", 0.0, 3.0)]
    vec = {r.cid: r.features for r in features.to_vectors(features.transform(long, fitted), 5).collect()}
    assert vec["b"] == Vectors.sparse(5, [3, 4], [1.0, 1.0])


def test_threshold_and_sweep(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 3, 3, 2, 0)], "g double")
    assert [evaluate.kth_largest(df, "g", k).first().threshold for k in (1, 2, 3, 9)] == [5.0, 3.0, 3.0, 2.0]
    assert evaluate.kth_largest(df.filter("g < 0"), "g", 1).first().threshold is None
    p = spark.createDataFrame([(1, 0.9), (1, -0.2), (0, 0.1), (0, -0.5)], "y int, s double")
    swept = evaluate.sweep(p, [], "s", F.col("y") == 1, -2, 4, 0.25)
    rows = {r.threshold: r for r in swept.collect()}
    assert len(rows) == 7 and (rows[0.0].tp, rows[0.0].fp, rows[0.0].fn) == (1, 1, 1) and rows[1.0].precision is None


def test_models_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(int(t), Vectors.dense(v)) for v, t in zip(x, y)], ["label", "features"]).cache()
    rows = models.class_weights(df)
    fitted = models.classifier("logistic", 200).fit(rows)
    good = models.scores(fitted, rows, ["label"]).select(((F.col("p1") > 0.5) == (F.col("label") == 1)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert good > 0.9
    stumps = models.boost(df, rounds=4)
    assert models.boosted_scores(stumps, df, ["label"]).agg(F.avg(((F.col("p1") > 0.5) == (F.col("label") == 1)).cast("int"))).first()[0] > 0.75
    w = models.huber_descent(df, 3, epochs=8)
    assert ((x @ w[:3] + w[3] > 0) == y).mean() > 0.9
    assert models.fourier_features(df, 3, 0.5, 16).first().features.size == 16
    held = models.scores(fitted, rows, ["label"])
    mapped = models.calibrated([models.calibrate(held)], held)
    assert mapped.filter("calibrated < 0 or calibrated > 1").count() == 0


def test_network_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] > 0).astype(int)
    net = network.Network([4, 16, 2], rate=0.01, drop_hidden=0.2, class_weights=(1.0, 1.0))
    best = network.train(net, x[:300], y[:300], x[300:], y[300:], rounds=30, batch=64)
    assert best["f1"] > 0.85 and len(network.bias_sweep(net, x[300:], y[300:])) == 10


def test_experiments(spark):
    from commitloom.ml import experiments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, int(v[0] > 0), Vectors.dense(v)) for i, v in enumerate(x)], ["row_id", "label", "features"]).cache()
    plan = windows.plan(spark, 300, 150, 60, 2, seed=4)
    scored = experiments.window_scores(df, plan, "tree")
    assert scored.count() == 120 and scored.filter("abs(p0 + p1 - 1) > 1e-9").count() == 0
    assert all(r.f1 > 0.9 for r in experiments.evaluate_windows(scored).collect())
    one = experiments.window_scores(df.withColumn("label", F.lit(0)), plan, "tree")
    assert {r.p1 for r in one.collect()} == {0.0}
    swept = experiments.parameter_sweep(df, plan, "logistic", [0.001, 1.0], lambda v, n: models.classifier("logistic", n, c=v))
    assert experiments.best_value(swept).first().value in (0.001, 1.0)
    assert experiments.curve(df, 300, "bayes", [100], [30, 60], 1).count() == 2


def test_more_features(spark):
    df = spark.createDataFrame([("a", '<git.Actor "A <a@b.c>">', "x", {"f": 2, "g": 8}, ["f"], None)], "cid string, author string, committer string, file_order map<string,int>, files array<string>, blueprint string")
    got = {r.feature: r.value for r in features.commit_features(df.withColumn("order", F.lit(1))).collect()}
    assert got["author_org=b.c"] == 1 and got["blueprint"] == 0 and abs(got["log_max_file_order"] - np.log(8)) < 1e-9 and got["includes_file_f"] == 1
    m = spark.createDataFrame([("a", "x.py", 3, 1), ("a", "tests/y.py", 1, 0)], "cid string, path string, cc int, new_functions int")
    assert {r.feature for r in features.metric_features(m, tests=False).collect()} == {"x.py_cc", "x.py_new_functions"}
