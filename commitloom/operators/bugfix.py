"""Which commits fix bugs, and whose lines they replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.parsing import weight_of


def qualified(importance: Column, status: Column, heat: Column, level: str = "low+", state: str = "fixed", least_heat: int = -1) -> Column:
    """Whether a bug counts: its status is of the class, and its importance is, or (with ``least_heat`` above 0) it is hot enough."""
    hot = (heat >= least_heat) if least_heat > 0 else F.lit(False)
    return F.coalesce(status.isin(K.STATUS[state]) & (importance.isin(K.IMPORTANCE[level]) | F.coalesce(hot, F.lit(False))), F.lit(False))


def qualified_links(links: DataFrame, bugs: DataFrame, level: str = "low+", state: str = "fixed", least_heat: int = -1) -> DataFrame:
    """The rows of ``links`` (with ``bug_id``) whose bug counts."""
    good = bugs.filter(qualified(F.col("importance"), F.col("status"), F.col("heat"), level, state, least_heat)).select(F.col("id").alias("bug_id")).distinct()
    return links.join(good, "bug_id", "left_semi")


def bug_fix_commits(links: DataFrame, bugs: DataFrame, **limits: object) -> DataFrame:
    """``cid``: commits with at least one bug that counts."""
    return qualified_links(links, bugs, **limits).select("cid").distinct()


def is_merge(commit: DataFrame) -> Column:
    """Whether a commit on the mainline of master merges others."""
    return commit["on_master_branch"] & commit["on_mainline"] & (F.coalesce(F.size(commit["parents"]), F.lit(0)) >= 2)


def fix_weight(weights: Column, level: str) -> Column:
    """The greatest weight of a fix's bugs above the base of the level, at least 0; ``weights`` is an array."""
    return F.greatest(F.coalesce(F.array_max(weights), F.lit(0)) - F.lit(K.BASE_LEVEL[level]), F.lit(0))


def mentions(text: Column, parts: Column, word: str = "blueprint") -> Column:
    """Whether a description, or one of the messages, mentions a word."""
    return F.coalesce(F.lower(text).contains(word), F.lit(False)) | F.coalesce(F.exists(parts, lambda m: F.coalesce(F.lower(m["content"]).contains(word), F.lit(False))), F.lit(False))


def legacy_cutoff(rows: DataFrame, has_mark: Column, date: Column) -> DataFrame:
    """``cutoff``: the date after which all commits carry review marks.

    One second before the first marked commit if that follows the last unmarked
    one, else the date of the last unmarked one.
    """
    ends = rows.agg(F.min(F.when(has_mark, date)).alias("first_with"), F.max(F.when(~has_mark, date)).alias("last_without"))
    return ends.select(F.when(F.col("last_without").isNull() | (F.col("first_with") > F.col("last_without")), F.col("first_with") - 1).otherwise(F.col("last_without")).alias("cutoff"))


def side_stats(closure: DataFrame, commits: DataFrame, links: DataFrame) -> DataFrame:
    """``merge, changes, bugs``: how many distinct changes and bugs (of ``links``) the commits that a merge brought in have."""
    changes = closure.join(commits.select(F.col("cid").alias("node"), "change_id"), "node").groupBy("merge").agg(F.count_distinct("change_id").alias("changes"))
    bugs = closure.join(links.select(F.col("cid").alias("node"), "bug_id"), "node").groupBy("merge").agg(F.count_distinct("bug_id").alias("bugs"))
    return changes.join(bugs, "merge", "left").fillna(0, ["bugs"])


def classify(commits: DataFrame, side: DataFrame, links: DataFrame, cutoff: int, date: str = "date") -> DataFrame:
    """``cid, kind``: how each commit of the mainline (the rows of ``commits`` with ``on_master_branch``) is treated.

    ``legacy`` (not after the cutoff, or undated), ``root`` (no parent), with one
    parent ``fast_forward_fix`` (it has a bug of ``links``), ``fast_forward``
    (it has a change id) or ``unexplained``; merges by the distinct changes and
    bugs that they bring (``side``): ``empty_merge`` (neither), ``revert`` (one
    change, both it and its second parent say Revert in the first line, and that
    parent has no change id), ``own_change`` (one change, but the merge has a
    change id of its own and no files: ignored), ``simple_merge`` (one change)
    and ``complex_merge``.
    """
    head = F.split_part(F.col("msg"), F.lit("\n"), F.lit(1)).contains("Revert")
    second = commits.select(F.col("cid").alias("p2"), F.coalesce(head & F.col("change_id").isNull(), F.lit(False)).alias("p2_reverts"))
    fixes = links.select("cid", F.lit(True).alias("fixes")).distinct()
    main = commits.filter(F.col("on_master_branch")).select("cid", "parents", "change_id", "msg", "files", date, F.try_element_at("parents", F.lit(2)).alias("p2"))
    rows = main.join(side.withColumnRenamed("merge", "cid"), "cid", "left").join(fixes, "cid", "left").join(second, "p2", "left")
    parents, none = F.greatest(F.size("parents"), F.lit(0)), F.lit(0)
    changes, bugs = F.coalesce("changes", none), F.coalesce("bugs", none)
    kind = (
        F.when(F.coalesce(date, none) <= cutoff, "legacy")
        .when(parents == 0, "root")
        .when((parents == 1) & F.col("fixes"), "fast_forward_fix")
        .when((parents == 1) & F.col("change_id").isNotNull(), "fast_forward")
        .when(parents == 1, "unexplained")
        .when((changes == 0) & (bugs == 0), "empty_merge")
        .when((changes == 1) & F.coalesce(head, F.lit(False)) & F.coalesce("p2_reverts", F.lit(False)), "revert")
        .when((changes == 1) & F.col("change_id").isNotNull() & (F.greatest(F.size("files"), none) == 0), "own_change")
        .when(changes == 1, "simple_merge")
        .otherwise("complex_merge")
    )
    return rows.select("cid", kind.alias("kind"))


def guilt_entries(kinds: DataFrame, commits: DataFrame, links: DataFrame, main_ancestor: DataFrame, closure: DataFrame, date: str = "date") -> DataFrame:
    """``cid, diff_commit, blame_commit, type, merge_commit, bug_id``: what to compare to find the lines that a fix replaced.

    ``links`` has the bugs that count.  A fast-forward fix compares itself with
    its parent, a simple merge its second parent with the first mainline ancestor
    of that.  In a complex merge each commit brought in that has a change id and
    a bug is compared on its own:

    * with its first parent, if that is on the mainline (``complex_merge_1``);
    * else, if it has children on the mainline, the earliest of them (ties by
      id) with that child's first parent (``complex_merge_2``);
    * else, if it has one parent, with that (``complex_merge_3``); a commit with
      several gives nothing.
    """
    main = F.coalesce("on_master_branch", F.lit(False))
    known = commits.select("cid", main.alias("main"), F.greatest(F.size("parents"), F.lit(0)).alias("n"), F.try_element_at("parents", F.lit(1)).alias("p1"), F.try_element_at("parents", F.lit(2)).alias("p2"), F.col("change_id").isNotNull().alias("tracked"))
    own = links.select("cid", "bug_id").distinct()
    out = ["cid", "diff_commit", "blame_commit", "type", "merge_commit", "bug_id"]

    forward = kinds.filter("kind = 'fast_forward_fix'").join(known, "cid").join(own, "cid")
    forward = forward.select("cid", F.col("cid").alias("diff_commit"), F.col("p1").alias("blame_commit"), F.lit("fast_forward").alias("type"), F.col("cid").alias("merge_commit"), "bug_id")

    brought = closure.join(own.withColumnRenamed("cid", "node"), "node").select("merge", "node", "bug_id").distinct()
    merges = kinds.withColumnRenamed("cid", "merge")
    simple = merges.filter("kind = 'simple_merge'").join(brought.select("merge", "bug_id").distinct(), "merge").join(known.select(F.col("cid").alias("merge"), "p2"), "merge").join(main_ancestor.select(F.col("node").alias("p2"), "stop"), "p2", "left")
    simple = simple.select(F.col("p2").alias("cid"), F.col("p2").alias("diff_commit"), F.col("stop").alias("blame_commit"), F.lit("simple_merge").alias("type"), F.col("merge").alias("merge_commit"), "bug_id")

    child = commits.filter(main).select(F.struct(F.col(date).isNull().alias("undated"), F.col(date).alias("at"), F.col("cid").alias("child"), F.try_element_at("parents", F.lit(1)).alias("base")).alias("c"), F.explode("parents").alias("node"))
    first_child = child.filter("node is not null").groupBy("node").agg(F.min("c").alias("c")).select("node", "c.child", "c.base")
    side = merges.filter("kind = 'complex_merge'").join(brought, "merge").join(known.filter("tracked").select(F.col("cid").alias("node"), "n", "p1"), "node")
    side = side.join(known.select(F.col("cid").alias("p1"), F.col("main").alias("from_main")), "p1", "left").join(first_child, "node", "left")
    first, second = F.coalesce("from_main", F.lit(False)), F.col("child").isNotNull()
    way = F.when(first, "complex_merge_1").when(second, "complex_merge_2").when(F.col("n") == 1, "complex_merge_3")
    complex_ = side.select(F.col("node").alias("cid"), F.when(~first & second, F.col("child")).otherwise(F.col("node")).alias("diff_commit"), F.when(~first & second, F.col("base")).otherwise(F.col("p1")).alias("blame_commit"), way.alias("type"), F.col("merge").alias("merge_commit"), "bug_id").filter("type is not null")
    return forward.select(out).unionByName(simple.select(out)).unionByName(complex_.select(out))


def entry_weights(entries: DataFrame, bugs: DataFrame, level: str) -> DataFrame:
    """Adds ``weight``: of the bugs of one comparison for one merge the greatest severity above the base of the level, at least 0."""
    keys = ["cid", "diff_commit", "type", "merge_commit"]  # these settle the base
    heavy = entries.join(bugs.select(F.col("id").alias("bug_id"), severity(F.col("importance")).alias("w")), "bug_id").groupBy(*keys).agg(F.greatest(F.max("w") - F.lit(K.BASE_LEVEL[level]), F.lit(0)).alias("weight"))
    return entries.join(heavy, keys)


def count_fixes(commits: DataFrame, least: int | None = None, most: int | None = None, cutoff: int = 0) -> DataFrame:
    """``fixes``: tagged bug fixes between the dates of the least and the greatest order, after the cutoff."""
    bounds = commits.agg(F.max(F.when(F.col("order") == least, F.col("date")) if least else F.lit(None).cast("bigint")).alias("lo"), F.max(F.when(F.col("order") == most, F.col("date")) if most else F.lit(None).cast("bigint")).alias("hi"))
    side = commits.crossJoin(F.broadcast(bounds))
    inside = (F.col("date") >= F.greatest(F.coalesce("lo", F.lit(cutoff)), F.lit(cutoff))) & (F.col("hi").isNull() | (F.col("date") <= F.col("hi")))
    return side.agg(F.count_if(inside & F.col("tagged_bug_fix")).alias("fixes"))


def prune_empty(commits: DataFrame, cutoff: int) -> DataFrame:
    """Master commits after the cutoff without files are no longer reachable."""
    gone = F.col("on_master_branch") & F.col("reachable") & (F.col("date") > cutoff) & (F.coalesce(F.size("files"), F.lit(0)) <= 0)
    return commits.withColumn("reachable", F.when(gone, F.lit(False)).otherwise(F.col("reachable")))


def severity(importance: Column) -> Column:
    return weight_of(importance, K.SEVERITY)
