"""Experiments: classifiers over time-ordered windows, curves over history and horizon, parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import evaluate, models, windows


def window_scores(data: DataFrame, plan: DataFrame, name: str, make: Callable[[int], object] | None = None) -> DataFrame:
    """``clf, iter, row_id, y, p0, p1, p_net``: a classifier trained on each window's history and applied to its future.

    ``data`` has ``row_id, label, features``.  The plan's windows are few; each
    trains on its own rows only.  A window whose training rows have one class
    predicts that class.
    """
    parts = cut(windows.assign(data, plan))
    out = []
    for (i,) in plan.select("iter").orderBy("iter").collect():
        train, test = parts.filter((F.col("iter") == i) & (F.col("part") == "train")), parts.filter((F.col("iter") == i) & (F.col("part") == "test"))
        n, ones = train.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not n or ones in (0, n, None):
            scored = test.select("row_id", "label", F.lit(float(bool(ones))).alias("p1"))
        else:
            estimator = make(n) if make else models.classifier(name, n)
            scored = models.scores(estimator.fit(models.class_weights(train)), test, ["row_id", "label"])
        out.append(scored.select(F.lit(name).alias("clf"), F.lit(i).alias("iter"), "row_id", F.col("label").cast("int").alias("y"), (1 - F.col("p1")).alias("p0"), "p1", (2 * F.col("p1") - 1).alias("p_net")))
    return reduce(DataFrame.unionAll, out)


def evaluate_windows(scored: DataFrame, keys: tuple[str, ...] = ("clf", "iter")) -> DataFrame:
    """Counts and rates of each iteration at the even threshold."""
    return evaluate.confusion(scored, list(keys), F.col("p_net") > 0, F.col("y") == 1)


def curve(data: DataFrame, rows: int, name: str, histories: Iterable[int], futures: Iterable[int], iterations: int = 10, seed: int = 0) -> DataFrame:
    """``clf, history, future, mean, std`` and counts over a grid of history and future sizes."""
    out = []
    for h in histories:
        for f in futures:
            plan = windows.plan(data.sparkSession, rows, h, f, iterations, seed)
            scored = evaluate_windows(window_scores(data, plan, name))
            out.append(evaluate.summarise(scored, ["clf"]).withColumns({"history": F.lit(h), "future": F.lit(f)}))
    return reduce(DataFrame.unionAll, out)


def parameter_sweep(data: DataFrame, plan: DataFrame, name: str, values: Iterable[float], make: Callable[[float, int], object], metric: str = "f1") -> DataFrame:
    """``value, mean, std`` of a metric for each value of a parameter (a validation curve, or one axis of a grid search)."""
    out = []
    for v in values:
        scored = evaluate_windows(window_scores(data, plan, f"{name}", lambda n, v=v: make(v, n)))
        out.append(evaluate.summarise(scored, [], metric).withColumn("value", F.lit(float(v))))
    return reduce(DataFrame.unionAll, out)


def best_value(swept: DataFrame) -> DataFrame:
    """The value with the greatest mean, the smaller of equal ones."""
    return swept.filter("mean is not null").agg(F.max_by("value", F.struct("mean", -F.col("value"))).alias("value"), F.max("mean").alias("mean"))
