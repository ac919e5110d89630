"""Scores of commits by the fixes that replaced their lines.

``blame`` tables have one row per line: the entry (fix) it belongs to, the
commit that wrote the line, and perhaps the file and the proximity to a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.parsing import policy_weight, weight_of
from ..runtime import fresh


def normalised(blame: DataFrame, entry: list[str], commit: str, weight: Column | None = None) -> DataFrame:
    """``entry, commit, guilt``: each entry's unit spread over the commits by their (weighted) lines.

    Lines are summed before anything is shuffled by entry, so an entry with very
    many lines is one row per commit by then.
    """
    w = F.sum(weight if weight is not None else F.lit(1.0)).alias("w")
    sums = blame.groupBy(*entry, commit).agg(w)
    return sums.withColumn("guilt", F.col("w") / F.sum("w").over(Window.partitionBy(*entry))).drop("w")


def proximity_weight(proximity: Column, base: float = 2.0, exponential: bool = True) -> Column:
    """Weight of a line by its distance from a change: base^-(p-1), or 1/p."""
    return F.pow(F.lit(base), 1 - proximity.cast("double")) if exponential else 1 / proximity.cast("double")


def by_file(blame: DataFrame, entry: list[str], path: str, weight: Column) -> DataFrame:
    """``entry, path, share``: each entry's unit spread over files."""
    return normalised(blame, entry, path, weight).withColumnRenamed("guilt", "share")


def raw_by_severity(shares: DataFrame, bugs_of_entry: DataFrame, entry: list[str], commit: str, levels: list[str]) -> DataFrame:
    """``commit, guilt, <level>...``: sums of the shares by severity of the entries' bugs; an entry with two bugs counts twice.

    ``bugs_of_entry`` has ``entry, importance``.
    """
    side = shares.join(bugs_of_entry, entry)
    return side.groupBy(commit).agg(F.sum("guilt").alias("guilt"), *[F.sum(F.when(F.col("importance") == lv, F.col("guilt")).otherwise(0.0)).alias(lv) for lv in levels])


def total_grid(raw: DataFrame, commit: str, severity_of: dict[str, int], levels: dict[str, int] | None = None, policies: list[str] | None = None) -> DataFrame:
    """``commit, policy, level, total``: raw sums weighted under every policy for every level (sixteen cells).

    ``raw`` has one column per severity name of ``severity_of``.
    """
    lv = levels or {k: K.BASE_LEVEL[k] for k in K.LEVELS}
    cells = []
    for policy in policies or K.POLICIES:
        for level, base in lv.items():
            parts = [F.col(s) * policy_weight(F.lit(w - base), policy) for s, w in severity_of.items() if w > base]
            cells.append(F.struct(F.lit(policy).alias("policy"), F.lit(level).alias("level"), (sum(parts[1:], parts[0]) if parts else F.lit(0.0)).alias("total")))
    cell = fresh([commit], "cell")
    return raw.select(commit, F.explode(F.array(*cells)).alias(cell)).select(commit, f"{cell}.policy", f"{cell}.level", f"{cell}.total")


def weighted(shares: DataFrame, bugs_of_entry: DataFrame, entry: list[str], commit: str, policy: str = "linear") -> DataFrame:
    """``commit, guilt`` under one policy."""
    side = shares.join(bugs_of_entry, entry).withColumn("w", weight_of(F.col("importance")))
    return side.filter("w > 0").groupBy(commit).agg(F.sum(F.col("guilt") * policy_weight(F.col("w"), policy)).alias("guilt"))


def small_entries(blame: DataFrame, entry: list[str], most: int = 3000) -> DataFrame:
    """Entries with fewer than ``most`` lines."""
    big = blame.groupBy(*entry).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select(*entry)
    return blame.join(big, entry, "left_anti")


def without_blame(entries: DataFrame, blame: DataFrame, key: list[str]) -> DataFrame:
    """Entries for which no line was blamed (an audit)."""
    return entries.join(blame.select(*key).distinct(), key, "left_anti")


def tag_fixes(commits: DataFrame, entries: DataFrame, blame: DataFrame) -> DataFrame:
    """Commits with ``tagged_bug_fix``: those whose comparison blamed at least one line."""
    tagged = entries.join(blame.select("diff_commit", "blame_commit").distinct(), ["diff_commit", "blame_commit"], "left_semi").select(F.col("diff_commit").alias("cid")).distinct().withColumn("tagged_bug_fix", F.lit(True))
    return commits.join(tagged, "cid", "left").fillna(False, ["tagged_bug_fix"])
