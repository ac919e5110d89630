"""Whose lines a fix replaced: changed lines of the parent joined with who wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import analysed_file
from ..langdiff.metrics import pair_changes
from ..runtime import cut
from . import ranges

KEYS = ["diff_commit", "blame_commit", "path"]


def changed_lines(diffs: DataFrame, limit: int = 4) -> DataFrame:
    """``diff_commit, blame_commit, path, lineno, proximity`` of patches (column ``diff_text``), for the files that are analysed."""
    kept = diffs.filter(analysed_file(F.col("path")))
    return ranges.proximity(ranges.diff_lines(kept, KEYS), KEYS, limit)


def changed_tree_lines(pairs: DataFrame, old: str = "source_parent", new: str = "source_new") -> DataFrame:
    """The same for Python files by their syntax trees: lines of changed statements, at proximity 1; sources that do not parse give none."""
    found = pair_changes(pairs, KEYS, old, new).filter("not invalid")
    spans = found.select(*KEYS, F.explode("ranges").alias("r")).select(*KEYS, "r.start", "r.end")
    return ranges.range_lines(spans, KEYS).withColumn("proximity", F.lit(1))


def blame_requests(lines: DataFrame) -> DataFrame:
    """``cid, path, start, end``: the runs of lines to ask for, so that no whole file is blamed for a few lines."""
    runs = ranges.line_runs(lines, KEYS)
    return runs.select(F.col("blame_commit").alias("cid"), "path", "start", "end").distinct()


def assign(lines: DataFrame, blamed: DataFrame) -> DataFrame:
    """``diff_commit, blame_commit, path, lineno, proximity, commit``: changed lines with the commit that wrote them."""
    who = blamed.filter("status = 'ok'").select(F.col("at").alias("blame_commit"), "path", "lineno", F.col("cid").alias("commit")).distinct()
    return lines.join(who, ["blame_commit", "path", "lineno"]).select(*KEYS, "lineno", "proximity", "commit")


def blame_status(lines: DataFrame, blamed: DataFrame) -> DataFrame:
    """``blame_commit, path, status`` of every file that was asked for: ok, empty, error, or missing."""
    asked = lines.select("blame_commit", "path").distinct()
    got = blamed.groupBy(F.col("at").alias("blame_commit"), "path").agg(F.min(F.when(F.col("status") == "ok", "a").when(F.col("status") == "empty", "b").otherwise("c")).alias("k"))
    return asked.join(got, ["blame_commit", "path"], "left").select("blame_commit", "path", F.when(F.col("k") == "a", "ok").when(F.col("k") == "b", "empty").when(F.col("k") == "c", "error").otherwise("missing").alias("status"))


def blame_of_fixes(pairs: DataFrame, repository: str, limit: int = 4) -> DataFrame:
    """From ``diff_commit, blame_commit`` to blamed lines, straight from a repository; each comparison is made once."""
    from ..sources import git

    lines = cut(changed_lines(git.diffs(pairs, repository), limit))
    return assign(lines, cut(git.blame(blame_requests(lines), repository)))


def reachable_from(samples: DataFrame, repository: str) -> DataFrame:
    """``cid``: commits that still have lines in analysed files at the sampled commits (column ``node``)."""
    from ..sources import git
    from .graph import reachable

    at = samples.select(F.col("node").alias("cid")).distinct()
    files = git.tree_files(at, repository).filter(analysed_file(F.col("path")))
    whole = files.select("cid", "path", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    found = git.blame(whole, repository).filter("status = 'ok'")
    return reachable(samples, found.select("at", "cid"))
