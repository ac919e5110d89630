"""Evaluation of predictions: confusion, sweeps over thresholds, calibration measures, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_total


def _rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy; null where they divide by zero."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": tp / F.nullif(tp + fp, F.lit(0.0)), "recall": tp / F.nullif(tp + fn, F.lit(0.0)), "f1": 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0)), "accuracy": (tp + tn) / F.nullif(tp + tn + fp + fn, F.lit(0.0))})


def _counts(hit: Column, truth: Column) -> list[Column]:
    return [F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"), F.count_if(~hit & ~truth).alias("tn")]


def confusion(df: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Counts and rates of each key."""
    return _rates(df.groupBy(*keys).agg(*_counts(predicted, truth)))


def sweep(df: DataFrame, keys: list[str], score: str, truth: Column, low: int, high: int, step: float = 0.025) -> DataFrame:
    """Counts and rates at thresholds ``low*step .. high*step`` (above the threshold counts as positive).

    The thresholds are whole multiples of the step, so none drifts.
    """
    thresholds = F.array(*[F.lit(i * step) for i in range(low, high + 1)])
    below = F.size(F.filter(thresholds, lambda t: F.col(score) > t))  # how many thresholds the score lies above
    flat = df.select(*keys, F.coalesce(below, F.lit(0)).alias("_b"), F.coalesce(truth, F.lit(False)).alias("_t"), F.col(score).isNotNull().alias("_known"))
    counts = flat.filter("_known").groupBy(*keys, "_b").agg(F.count_if("_t").alias("p"), F.count_if(~F.col("_t")).alias("q"))
    packed = counts.groupBy(*keys).agg(F.collect_list(F.struct("_b", "p", "q")).alias("c"), F.sum("p").alias("ps"), F.sum("q").alias("qs"))  # one entry for each threshold at most
    side = packed.select(*keys, "c", "ps", "qs", F.posexplode(thresholds).alias("_i", "threshold"))
    above = F.filter("c", lambda x: x["_b"] > F.col("_i"))
    side = side.select(*keys, "threshold", "ps", "qs", F.aggregate(above, F.lit(0).cast("bigint"), lambda a, x: a + x["p"]).alias("tp"), F.aggregate(above, F.lit(0).cast("bigint"), lambda a, x: a + x["q"]).alias("fp"))
    return _rates(side.select(*keys, "threshold", "tp", "fp", (F.col("ps") - F.col("tp")).alias("fn"), (F.col("qs") - F.col("fp")).alias("tn")))


def calibration(df: DataFrame, keys: list[str], p: str, y: str, eps: float = 1e-15) -> DataFrame:
    """``log_loss, brier`` of each key."""
    clipped = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*keys).agg((-F.avg(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def conditional_cube(df: DataFrame, flags: dict[str, Column], y: str, least: int = 10) -> DataFrame:
    """Per combination of flags: count and rate of positives, null below ``least`` rows."""
    return df.select(*[c.cast("int").alias(n) for n, c in flags.items()], y).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_p")).select(*flags, "n", F.when(F.col("n") >= least, F.col("_p")).alias("p"))


def summarise(scores: DataFrame, keys: list[str], metric: str = "f1") -> DataFrame:
    """Mean and population deviation of a metric over iterations, with summed counts."""
    return scores.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("tn").alias("tn"))


def ensemble(predictions: DataFrame, keys: list[str], p: str = "p_net", offset: float = 0.0) -> DataFrame:
    """The mean score of several classifiers on the same rows, shifted by ``offset``."""
    return predictions.groupBy(*keys).agg((F.avg(p) + offset).alias(p), F.first("y").alias("y"), F.count(F.lit(1)).alias("classifiers"))


def stack_outputs(predictions: DataFrame, keys: list[str], classifiers: list[str], p: str = "p1") -> DataFrame:
    """One row per key with each classifier's score and its complement as columns."""
    return predictions.groupBy(*keys).agg(F.first("y").alias("y"), *[x for c in classifiers for x in (F.max(F.when(F.col("clf") == c, F.col(p))).alias(c), (1 - F.max(F.when(F.col("clf") == c, F.col(p)))).alias(f"{c}_not"))])


def best_threshold(swept: DataFrame, keys: list[str], metric: str = "f1") -> DataFrame:
    """Per key the threshold with the best metric, the lower of equal ones."""
    return swept.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(F.max_by("threshold", F.struct(metric, -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def accuracy_by_distance(df: DataFrame, horizons: list[int], row_id: str, predicted: Column, truth: Column) -> DataFrame:
    """``horizon`` and accuracy over the first rows of a test, for several lengths."""
    side = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int"))).filter(F.col(row_id) < F.col("horizon"))
    return side.groupBy("horizon").agg(F.avg((predicted == truth).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    """``threshold``: the k-th greatest value, so that at least k rows reach it; the least positive one if fewer are positive, null if none.

    Distinct values with their counts are summed up in ranges, never in one task.
    """
    counts = df.filter(F.col(value) > 0).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("v"))
    run = running_total(counts, ["down"], "n", "upto")
    return run.agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("v"))), F.min("v")).alias("threshold"))


def count_reaching(df: DataFrame, value: str, threshold: float) -> DataFrame:
    return df.agg(F.count_if(F.col(value) >= threshold).alias("n"))
