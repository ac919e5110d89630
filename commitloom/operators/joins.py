"""Joins and set operations of the three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import cherry_picked_from
from ..runtime import current_rows


def commit_bug_links(commits: DataFrame, bugs: DataFrame) -> DataFrame:
    """``cid, bug_id``: commits with the bugs they name, or that name them.

    Both paths are equi-joins whose union is made distinct; one join with an OR
    condition would compare all pairs.
    """
    named = commits.select("cid", F.explode("bugs").alias("bug_id")).join(bugs.select(F.col("id").alias("bug_id")).distinct(), "bug_id", "left_semi").select("cid", "bug_id")
    naming = bugs.select(F.col("id").alias("bug_id"), F.explode("commits").alias("c")).select(F.col("c.cid").alias("cid"), "bug_id").join(commits.select("cid").distinct(), "cid", "left_semi")
    return named.unionByName(naming).distinct()


def join_with_bugs(commits: DataFrame, bugs: DataFrame) -> DataFrame:
    """Commits with a column ``bug_details``: the linked bugs, sorted by id; null if none.

    The bugs of one commit are collected, which its own lists bound.
    """
    details = commit_bug_links(commits, bugs).join(bugs.withColumnRenamed("id", "bug_id"), "bug_id")
    kept = F.struct("bug_id", "importance", "status", "heat", "security_related", F.greatest(F.size("cves"), F.lit(0)).alias("n_cves"), F.greatest(F.size("messages"), F.lit(0)).alias("n_messages"))
    packed = details.groupBy("cid").agg(F.array_sort(F.collect_list(kept)).alias("bug_details"))
    return commits.join(packed, "cid", "left")


def join_with_reviews(commits: DataFrame, changes: DataFrame, details: DataFrame, project: str | None = None, branch: str = "master", status: str = "MERGED") -> DataFrame:
    """Commits with summary and detail of their merged review, which both must be there; the latest of each change id counts."""

    def picked(df: DataFrame) -> DataFrame:
        own = df.filter((F.col("branch") == branch) & (F.col("status") == status) & F.col("change_id").isNotNull())
        own = own.filter(F.col("project").endswith(project)) if project else own
        return current_rows(own, ["change_id"], tie=["_number"])

    summary = picked(changes).select("change_id", F.col("_number").alias("number"), "project", "branch", "_sortkey")
    detail = picked(details).select("change_id", "owner", "labels", "messages")
    return commits.join(summary.join(detail, "change_id"), "change_id", "left")


def missing_keys(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct referenced keys that are not known (what a directed fetch must get)."""
    return references.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def new_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet (an incremental refresh)."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def merge_prior_wins(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keyed union in which rows that were there before win."""
    return prior.unionByName(new_rows(new, prior, key))


def cherry_picks(commits: DataFrame) -> DataFrame:
    """``cid, picked_from``: master commits picked from a commit that is known."""
    picks = commits.filter(F.col("on_master_branch")).select("cid", cherry_picked_from(F.col("msg")).alias("picked_from")).filter("picked_from is not null")
    return picks.join(commits.select(F.col("cid").alias("picked_from")).distinct(), "picked_from", "left_semi").select("cid", "picked_from").distinct()


def picked_to(picks: DataFrame) -> DataFrame:
    """``cid, picked_to``: the reverse of cherry picks, sorted lists."""
    return picks.groupBy(F.col("picked_from").alias("cid")).agg(F.array_sort(F.collect_list("cid")).alias("picked_to"))


def children(commits: DataFrame) -> DataFrame:
    """``parent, child, pos``: links of master commits to all their parents."""
    return commits.filter(F.col("on_master_branch")).select(F.col("cid").alias("child"), F.posexplode("parents").alias("pos", "parent")).filter("parent is not null and trim(parent) <> ''").select("parent", "child", "pos")


def drop_columns(df: DataFrame, excluded: list[str]) -> DataFrame:
    """Without the columns that a source is known to carry for nothing; absent ones are ignored."""
    return df.drop(*excluded)


def last_assignment(fields: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """``key, value`` where of several assignments the last by ``pos`` counts."""
    return fields.groupBy(key).agg(F.max_by(value, pos).alias(value))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
