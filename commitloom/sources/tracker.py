"""Offline readers of bug-tracker and review dumps, with incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.parsing import tracker_links
from ..operators.joins import merge_prior_wins, new_rows
from . import jsonl, schemas


def read_bugs(spark: SparkSession, path: str, prior: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Bugs of a dump; with ``wanted`` (column id) only those, with ``prior`` merged into what is there, which wins."""
    bugs = jsonl.read_records(spark, path, schemas.BUGS).drop("json_key")
    if wanted is not None:
        bugs = bugs.join(wanted.select("id"), "id", "left_semi")
    return merge_prior_wins(prior, bugs, "id") if prior is not None else bugs


def bug_commits(bugs: DataFrame, commit_urls: list[str]) -> DataFrame:
    """Bugs with ``commits``: the change and commit that each message names together."""
    found = F.filter(F.transform("messages", lambda m: tracker_links(m["content"], commit_urls)), lambda x: x.isNotNull())
    return bugs.withColumn("commits", F.coalesce(found, F.expr("cast(array() as array<struct<change_id:string,cid:string>>)")))


def worked_on(bugs: DataFrame) -> DataFrame:
    """Ids of bugs that somebody works on or has fixed."""
    return bugs.filter(F.col("status").isin(*K.STATUS["fixed"], "Confirmed", "In Progress")).select("id").distinct()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Review summaries of a dump."""
    return jsonl.read_records(spark, path, schemas.CHANGES).drop("json_key")


def read_details(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Review details of a dump; those whose change is ``known`` are left out."""
    details = jsonl.read_records(spark, path, schemas.DETAILS).drop("json_key")
    return new_rows(details, known, "change_id") if known is not None else details


def page_after(changes: DataFrame, after: str | None, size: int) -> DataFrame:
    """The page that follows a sort key, newest first (keyset pagination)."""
    rest = changes.filter(F.col("_sortkey") < after) if after is not None else changes
    return rest.orderBy(F.col("_sortkey").desc(), "_number").limit(size)


def counts(commits: DataFrame) -> DataFrame:
    """How many commits there are, with bugs, with change ids, with both."""
    bugs, change = F.size("bugs") > 0, F.col("change_id").isNotNull()
    return commits.agg(F.count(F.lit(1)).alias("total"), F.count_if(bugs).alias("with_bugs"), F.count_if(change).alias("with_change"), F.count_if(bugs & change).alias("with_both"))
