"""Classifiers on windows: the library's own, boosted stumps, kernel approximation, calibration.

Two kinds have no exact counterpart: extremely randomised trees are forests with
one random feature subset per split, and kernel machines are linear ones on
random Fourier features.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``: rows over (classes times rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"), F.count_distinct(label).alias("_k"))
    return df.join(F.broadcast(n.crossJoin(total)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def classifier(name: str, rows: int | None = None, c: float = 1.0, seed: int = 0):
    """An estimator by name: logistic, linear_svc, tree, forest, extra_trees, boosting, bayes."""
    common = {"labelCol": "label", "featuresCol": "features"}
    if name == "logistic":
        return LogisticRegression(regParam=1 / (c * (rows or 1)), elasticNetParam=0.0, standardization=False, weightCol="weight", **common)
    if name == "linear_svc":
        return LinearSVC(regParam=1 / (c * (rows or 1)), standardization=False, **common)
    if name == "tree":
        return DecisionTreeClassifier(seed=seed, **common)
    if name == "forest":
        return RandomForestClassifier(seed=seed, **common)
    if name == "extra_trees":
        return RandomForestClassifier(seed=seed, featureSubsetStrategy="onethird", subsamplingRate=1.0, bootstrap=False, **common)
    if name == "boosting":
        return GBTClassifier(seed=seed, **common)
    if name == "bayes":
        return NaiveBayes(modelType="gaussian", **common)
    raise ValueError(name)


def scores(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, p1``: the probability of the positive class, or the squashed margin where a model has none."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(*keep, p.alias("p1"))


def boost(df: DataFrame, rounds: int = 40, rate: float = 1.2, depth: int = 1) -> list[tuple[float, object]]:
    """Boosted stumps (SAMME) with weighted trees: pairs of weight and model; stops at a perfect or a useless stump."""
    rows = cut(df.select("label", "features", (F.lit(1.0) / df.count()).alias("w")))
    out: list[tuple[float, object]] = []
    for _ in range(rounds):
        model = DecisionTreeClassifier(maxDepth=depth, weightCol="w", labelCol="label", featuresCol="features").fit(rows)
        seen = model.transform(rows).select("label", "features", "w", (F.col("prediction") != F.col("label")).alias("wrong"))
        err, total = seen.agg(F.sum(F.when(F.col("wrong"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
        err = err / total
        if err >= 0.5:
            break
        if err <= 0:
            out.append((1.0, model))
            break
        alpha = rate * math.log((1 - err) / err)
        out.append((alpha, model))
        grown = seen.withColumn("w", F.col("w") / F.lit(total) * F.when(F.col("wrong"), F.exp(F.lit(alpha))).otherwise(F.lit(1.0)))
        rows = cut(grown.select("label", "features", "w"))
    return out


def boosted_scores(models: list[tuple[float, object]], df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, p1`` of boosted stumps: the weighted vote for the positive class."""
    total = sum(a for a, _ in models) or 1.0
    out, votes = df, F.lit(0.0)
    for i, (a, m) in enumerate(models):
        out = m.transform(out).withColumnRenamed("prediction", f"_v{i}").drop("rawPrediction", "probability")
        votes = votes + F.col(f"_v{i}") * (a / total)
    return out.select(*keep, votes.alias("p1"))


def fourier_features(df: DataFrame, size: int, gamma: float, dimensions: int = 200, seed: int = 0) -> DataFrame:
    """Random Fourier features of a radial kernel, in place of ``features``."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=math.sqrt(2 * gamma), size=(size, dimensions)), rng.uniform(0, 2 * math.pi, dimensions)

    @F.pandas_udf("array<double>")
    def project(x):
        import pandas as pd

        z = np.stack(x.to_numpy()) @ w + b
        return pd.Series(list(np.sqrt(2 / dimensions) * np.cos(z)))

    return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def calibrate(held_out: DataFrame, score: str = "p1"):
    """An isotonic map from scores on held-out rows (with ``label``) to probabilities."""
    return IsotonicRegression(featuresCol=score, labelCol="label", predictionCol="calibrated").fit(held_out.select(score, F.col("label").cast("double").alias("label")))


def calibrated(models: list, df: DataFrame, score: str = "p1") -> DataFrame:
    """``df`` with ``calibrated``, the mean over the folds' maps."""
    out, total = df, F.lit(0.0)
    for i, m in enumerate(models):
        out = m.transform(out).withColumnRenamed("calibrated", f"_c{i}")
        total = total + F.col(f"_c{i}")
    return out.withColumn("calibrated", total / max(1, len(models))).drop(*[f"_c{i}" for i in range(len(models))])


def huber_descent(df: DataFrame, size: int, epochs: int = 20, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a linear classifier under the modified Huber loss, by full gradients summed where the rows lie."""
    w = np.zeros(size + 1)
    rows = cut(df.select(vector_to_array("features").alias("x"), (F.col("label") * 2 - 1).alias("y")))
    n = rows.count()
    for epoch in range(epochs):
        now = w.copy()

        def gradient(frames, now=now):
            import pandas as pd

            g = np.zeros(size + 1)
            for f in frames:
                if len(f):
                    x = np.hstack([np.stack(f["x"].to_numpy()), np.ones((len(f), 1))])
                    z = f["y"].to_numpy() * (x @ now)
                    slope = np.where(z >= 1, 0.0, np.where(z >= -1, -2 * (1 - z), -4.0)) * f["y"].to_numpy()
                    g += slope @ x
            yield pd.DataFrame({"i": np.arange(size + 1), "g": g})

        sums = rows.mapInPandas(gradient, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
        g = np.zeros(size + 1)
        for r in sums:
            g[r["i"]] = r["g"]
        w -= rate / (1 + epoch) ** 0.5 * (g / max(n, 1) + l2 * w)
    return w


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
