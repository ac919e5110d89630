"""Author-level analytics: counts, scores, trimming, cumulative curves, histograms, anonymous names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import fresh
from .ordering import dense_order, running_total


def per_author(rows: DataFrame, author: str, guilt: str) -> DataFrame:
    """``author, commits, guilt, rate``: counts, sums and the sum per commit."""
    return rows.groupBy(author).agg(F.count(F.lit(1)).alias("commits"), F.sum(guilt).alias("guilt")).withColumn("rate", F.col("guilt") / F.col("commits"))


def active(authors: DataFrame, least: int = 10) -> DataFrame:
    """Authors with more than ``least`` commits."""
    return authors.filter(F.col("commits") > least)


def percentiles(df: DataFrame, value: str, parts: dict[str, float]) -> DataFrame:
    """One row with the exact, linearly interpolated percentiles ``name: part``; nulls are left out, no values give nulls.

    Counts of distinct values are summed up in ranges; the values at the two
    places around each percentile are picked from the sums.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = running_total(counts, ["v"], "n", "upto").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    picked = []
    for name, part in parts.items():
        place = (F.col("all") - 1) * F.lit(part)
        picked += [F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).alias(f"{name}_a"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).alias(f"{name}_b"), F.max(place - F.floor(place)).alias(f"{name}_f")]
    return run.agg(*picked).select(*[(F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_f")).alias(n) for n in parts])


def trim(df: DataFrame, value: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Rows whose value lies within two percentiles (exact, linear), both included; nulls are left out."""
    lo, hi = fresh(df.columns, "_lo"), fresh(df.columns, "_hi")
    ends = percentiles(df, value, {lo: lower, hi: upper})
    return df.crossJoin(F.broadcast(ends)).filter(F.col(value).between(F.col(lo), F.col(hi))).drop(lo, hi)


def cumulative(authors: DataFrame, value: str, rank: str, key: str) -> DataFrame:
    """``key, position, total, x, y``: the running sum of ``value`` by descending ``rank``.

    ``x`` is the part of the authors in percent, ``y`` the part of the final sum.
    Authors are ranked and summed up in ranges, never in one task.
    """
    down = fresh(authors.columns, "_down")
    rows = authors.select(key, rank, value, (-F.col(rank)).alias(down))
    run = dense_order(running_total(rows, [down, key], value, "total"), [down, key], "_n")
    every = authors.agg(F.count(F.lit(1)).alias("_authors"), F.sum(value).alias("_all"))
    return run.crossJoin(F.broadcast(every)).select(key, (F.col("_n") - 1).alias("position"), "total", (100.0 * (F.col("_n") - 1) / F.col("_authors")).alias("x"), (F.col("total") / F.col("_all")).alias("y"))


def histogram(df: DataFrame, value: str, width: float, start: float = 0.0) -> DataFrame:
    """``bin, n, running``: counts by bins of equal width, and their running sum; empty bins are left out."""
    bins = df.filter(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - start) / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.withColumn("running", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, q1, median, q3``: exact quartiles of each key (the data of a box plot)."""
    return df.groupBy(key).agg(*[F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def top(df: DataFrame, by: str, key: str, n: int = 10, descending: bool = True) -> DataFrame:
    """The first ``n`` rows by a value, ties by key."""
    return df.orderBy(F.col(by).desc() if descending else F.col(by).asc(), key).limit(n)


def anonymous(df: DataFrame, local: Column, domain: Column, first_seen: str, name: str = "anonymous") -> DataFrame:
    """Adds ``anon_N@domain``, N by the first time that a local part is seen (ties by the part)."""
    part = fresh(df.columns, "_local")
    rows = df.withColumn(part, local)
    order = rows.groupBy(part).agg(F.min(first_seen).alias("_first"))
    numbered = dense_order(order, ["_first", part], "_n")
    return rows.join(numbered.select(part, "_n"), part, "left").withColumn(name, F.concat(F.lit("anon_"), F.col("_n").cast("string"), F.lit("@"), domain)).drop(part, "_n")
