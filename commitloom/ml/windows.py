"""Time-ordered training and test windows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "iter int, train_from long, train_to long, test_from long, test_to long"


def plan(spark: SparkSession, n: int, history: int, future: int, iterations: int = 10, seed: int | None = None, ignore: float = 0) -> DataFrame:
    """Random windows over rows 0..n-1: training on ``history`` rows, testing on the ``future`` ones that follow (ends exclusive).

    The last ``ignore`` rows (a fraction, if below 1) are never used; a history
    that does not fit is cut.  No room for a test gives no windows.
    """
    usable = n - int(n * ignore if 0 < ignore < 1 else ignore)
    history = min(history, usable - future)
    if history <= 0 or future <= 0:
        return spark.createDataFrame([], SCHEMA)
    rng = random.Random(seed)
    starts = [rng.randint(history, usable - future) for _ in range(iterations)]
    return spark.createDataFrame([(i, s - history, s, s, s + future) for i, s in enumerate(starts)], SCHEMA)


def assign(rows: DataFrame, windows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows with ``iter`` and ``part`` (train or test), once per window that they lie in; the plan has one row per iteration, which bounds it."""
    r = F.col(row_id)
    side = rows.join(F.broadcast(windows), (r >= F.col("train_from")) & (r < F.col("test_to")))
    return side.withColumn("part", F.when(r < F.col("train_to"), "train").otherwise("test")).drop("train_from", "train_to", "test_from", "test_to")


def assign_three(rows: DataFrame, windows: DataFrame, validate: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Training, test and validation parts: rows before the last ``validate`` of each window are shuffled into training and test."""
    side = assign(rows, windows, row_id).drop("part").join(F.broadcast(windows), "iter")
    r = F.col(row_id)
    held = r >= F.col("test_to") - validate
    mixed = F.row_number().over(Window.partitionBy("iter", held).orderBy(F.xxhash64(F.lit(seed), row_id), row_id))
    size = F.col("train_to") - F.col("train_from")
    return side.withColumn("part", F.when(held, "validate").when(mixed <= size, "train").otherwise("test")).drop("train_from", "train_to", "test_from", "test_to")
