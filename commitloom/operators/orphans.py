"""References to records that do not exist: missing, deleted or late.

References and the keys of their target table are brought to one canonical
form, co-partitioned and sorted on it, and merged (a sort-merge join).  What a
key meets is the validity interval of its target: from the earliest row of any
record that is meant to the deletion of the last one, if all are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh

#: A shortened commit id of at least this many characters is looked up by that
#: many leading characters; shorter ones, down to SHORT_CID, by SHORT_CID.
LONG_PREFIX, SHORT_CID = 7, 4


def canonical_change(value: Column) -> Column:
    """The change id meant: ``I`` and 40 hexadecimal digits, wherever they stand, in any letter case."""
    digits = F.regexp_extract(value, "(?:^|[^0-9A-Za-z])[Ii]([0-9A-Fa-f]{40})(?![0-9A-Za-z])", 1)
    return F.when(digits != "", F.concat(F.lit("I"), F.lower(digits)))


def canonical_bug(value: Column) -> Column:
    """The bug number meant: the last run of digits, without leading zeros."""
    digits = F.regexp_extract(value, r"0*(\d+)\D*$", 1)
    return F.when(digits != "", digits)


def canonical_commit(value: Column) -> Column:
    """The commit id meant, whole or shortened: the last run of 4 to 40 hexadecimal digits that is a word, in lower case."""
    digits = F.regexp_extract(value, r"(?:^|[^0-9A-Za-z])([0-9A-Fa-f]{4,40})[^0-9A-Za-z]*$", 1)
    return F.when(digits != "", F.lower(digits))


def target_intervals(rows: DataFrame, record: str, key: Column, version: str = "ingested_at", tombstone: str = "tombstone") -> DataFrame:
    """``target, valid_from, all_deleted`` for each canonical key of a version log.

    ``record`` identifies a record (several records may share a key, as changes
    on several branches share a change id).  A record is deleted if its current
    row is a tombstone; a null flag means not deleted.
    """
    slim = rows.select(F.col(record).alias("record"), key.alias("target"), F.col(version).alias("at"), F.coalesce(F.col(tombstone), F.lit(False)).alias("dead"))
    records = slim.groupBy("record").agg(F.max("target").alias("target"), F.min("at").alias("first_at"), F.max_by("dead", "at").alias("dead"))
    return records.filter(F.col("target").isNotNull()).groupBy("target").agg(F.min("first_at").alias("valid_from"), F.bool_and(F.coalesce(F.col("dead"), F.lit(False))).alias("all_deleted"))


def references(rows: DataFrame, record: str, uses: DataFrame, version: str = "ingested_at", tombstone: str = "tombstone") -> DataFrame:
    """``src_key, ref_field, ref_value, made_at``: the references that any row of an undeleted record makes.

    ``uses`` has the columns ``src_key, ref_field, ref_value, at``, one row per
    use.  Null and blank values are no references; repeated uses count once,
    from the earliest row on.
    """
    real = uses.filter(F.col("ref_value").isNotNull() & (F.trim(F.regexp_replace("ref_value", r"\s+", " ")) != ""))
    made = real.groupBy("src_key", "ref_field", "ref_value").agg(F.min("at").alias("made_at"))
    slim = rows.select(F.col(record).alias("src_key"), F.col(version).alias("at"), F.coalesce(F.col(tombstone), F.lit(False)).alias("dead"))
    alive = slim.groupBy("src_key").agg(F.max_by("dead", "at").alias("dead")).filter(~F.col("dead"))
    return made.join(alive.select("src_key"), "src_key", "left_semi")


def resolve_shortened(short: DataFrame, full: DataFrame) -> DataFrame:
    """Intervals of shortened ids: over all targets that begin with them.

    ``short`` has distinct values in column ``target``.  The merge key is the
    longest prefix that every value of its kind has, which for commit ids is
    nearly unique.
    """
    parts = []
    for width, some in ((LONG_PREFIX, F.length("target") >= LONG_PREFIX), (SHORT_CID, F.length("target") < LONG_PREFIX)):
        left = short.filter(some).select(F.col("target").alias("short"), F.substring("target", 1, width).alias("head"))
        right = full.select("target", "valid_from", "all_deleted", F.substring("target", 1, width).alias("head"))
        parts.append(left.join(right, "head").filter(F.col("target").startswith(F.col("short"))).select("short", "valid_from", "all_deleted"))
    return parts[0].unionAll(parts[1]).groupBy(F.col("short").alias("target")).agg(F.min("valid_from").alias("valid_from"), F.bool_and("all_deleted").alias("all_deleted"))


def orphans(refs: DataFrame, intervals: DataFrame, canonical: Callable[[Column], Column], whole: int | None = None) -> DataFrame:
    """The orphans among ``refs``, with ``reason`` missing, deleted or late.

    ``whole`` is the length of a whole key where keys may be shortened.  A value
    from which no key can be read is missing.  A target that arrived before or
    together with the reference is not late; a null arrival is never late.
    """
    name = fresh(refs.columns, "target")
    wanted = refs.withColumn(name, canonical(F.col("ref_value")))
    known = intervals
    if whole:
        short = wanted.filter(F.length(name) < whole).select(F.col(name).alias("target")).distinct()
        known = intervals.unionByName(resolve_shortened(short, intervals))
    known = known.select(F.col("target").alias(name), "valid_from", "all_deleted")
    reason = F.when(F.col("valid_from").isNull() & F.col("all_deleted").isNull(), "missing").when(F.col("all_deleted"), "deleted").when(F.col("valid_from") > F.col("made_at"), "late")
    return wanted.join(known.hint("merge"), name, "left").withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop(name, "valid_from", "all_deleted")


def repository_orphans(commits: DataFrame, changes: DataFrame, bugs: DataFrame) -> DataFrame:
    """Orphan references of commits and bugs: ``src_table, src_key, ref_field, ref_value, made_at, reason``.

    Nulls at any level of the nested columns are skipped.  Empty tables give no
    rows, an empty target table makes every reference missing.
    """
    at = F.col("ingested_at").alias("at")
    to_change = commits.select(F.col("cid").alias("src_key"), F.lit("change_id").alias("ref_field"), F.col("change_id").alias("ref_value"), at)
    to_bug = commits.select(F.col("cid").alias("src_key"), F.lit("bugs").alias("ref_field"), F.explode("bugs").alias("ref_value"), at)
    listed = bugs.select(F.col("id").alias("src_key"), F.explode("commits").alias("c"), at).select("src_key", "at", F.explode(F.array(F.struct(F.lit("commits.cid").alias("f"), F.col("c.cid").alias("v")), F.struct(F.lit("commits.change_id").alias("f"), F.col("c.change_id").alias("v")))).alias("x"))
    from_bug = listed.select("src_key", F.col("x.f").alias("ref_field"), F.col("x.v").alias("ref_value"), "at")
    of_commits = references(commits, "cid", to_change.unionAll(to_bug))
    of_bugs = references(bugs, "id", from_bug)
    change_at = target_intervals(changes, "_number", canonical_change(F.col("change_id")))
    bug_at = target_intervals(bugs, "id", canonical_bug(F.col("id")))
    commit_at = target_intervals(commits, "cid", F.lower("cid"))
    parts = [
        orphans(of_commits.filter("ref_field = 'change_id'").withColumn("src_table", F.lit("commits")).unionAll(of_bugs.filter("ref_field = 'commits.change_id'").withColumn("src_table", F.lit("bugs"))), change_at, canonical_change),
        orphans(of_commits.filter("ref_field = 'bugs'").withColumn("src_table", F.lit("commits")), bug_at, canonical_bug),
        orphans(of_bugs.filter("ref_field = 'commits.cid'").withColumn("src_table", F.lit("bugs")), commit_at, canonical_commit, whole=40),
    ]
    cols = ["src_table", "src_key", "ref_field", "ref_value", "made_at", "reason"]
    return parts[0].select(cols).unionAll(parts[1].select(cols)).unionAll(parts[2].select(cols))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted by referring table and field, month of arrival of the reference, and reason."""
    return found.groupBy("src_table", "ref_field", F.date_format("made_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("orphans"))
