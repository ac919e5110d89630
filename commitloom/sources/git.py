"""Git repositories as data sources: commits, changed files, trees and blame, straight from the ``git`` command.

Commands are argument lists, never shell text.  The repository must lie at the
same path on every machine.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.parsing import bug_ids, change_id
from ..runtime import cut

LOG_SCHEMA = "cid string, parents array<string>, author string, committer string, date bigint, msg string"
_FIELDS = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%cn%x1f%ce%x1f%ct%x1f%B"


def run_git(repository: str, *args: str) -> str:
    """The output of a git command; a failure is an error with git's own words."""
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-C", repository, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "replace")


class _Slice(InputPartition):
    def __init__(self, skip: int, size: int) -> None:
        super().__init__(skip)
        self.skip, self.size = skip, size


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repository = options["path"]
        self.size = int(options.get("slice", 5000))

    def partitions(self) -> list[InputPartition]:
        n = int(run_git(self.repository, "rev-list", "--all", "--count").strip() or 0)
        return [_Slice(a, self.size) for a in range(0, max(n, 1), self.size)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        text = run_git(self.repository, "log", "--all", "--topo-order", f"--skip={part.skip}", f"--max-count={part.size}", f"--format={_FIELDS}")
        for record in text.split("\x1e")[1:]:
            cid, parents, an, ae, cn, ce, ct, body = record.split("\x1f", 7)
            yield cid, parents.split(), f'<git.Actor "{an} <{ae}>">', f'<git.Actor "{cn} <{ce}>">', int(ct), body.rstrip("\n")


class GitLogSource(DataSource):
    """``spark.read.format("git_log").load(repository)``: one row per commit of all branches, read in slices."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


def read_commits(spark: SparkSession, repository: str, head: str = "master", known: DataFrame | None = None) -> DataFrame:
    """All commits with what their messages say and whether ``head`` reaches them; commits already ``known`` are left out."""
    spark.dataSource.register(GitLogSource)
    commits = spark.read.format("git_log").load(repository)
    if known is not None:
        commits = commits.join(known.select("cid"), "cid", "left_anti")
    reached = spark.createDataFrame([(c,) for c in run_git(repository, "rev-list", head).split()], "cid string").withColumn("on_master_branch", F.lit(True))
    ascii_only = F.regexp_replace("msg", r"[^\x00-\x7F]", "")
    return commits.join(reached, "cid", "left").fillna(False, ["on_master_branch"]).withColumn("msg", ascii_only).withColumn("bugs", bug_ids(F.col("msg"))).withColumn("change_id", change_id(F.col("msg")))


def head_commit(repository: str, branch: str = "master") -> str:
    """The commit at the head of a branch."""
    return run_git(repository, "rev-parse", branch).strip()


def changed_files(commits: DataFrame, repository: str) -> DataFrame:
    """``cid, status, old_path, path``: files against the first parent (all files of a root), A, M or D; the missing side is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for cid in f["cid"]:
                text = run_git(repository, "diff-tree", "-r", "-z", "--root", "--no-renames", "--no-commit-id", "--name-status", "-m", "--first-parent", cid)
                parts = text.split("\0")
                for status, path in zip(parts[0::2], parts[1::2]):
                    s = status.strip()[:1]
                    rows.append((cid, s, None if s == "A" else path, None if s == "D" else path))
            yield pd.DataFrame(rows, columns=["cid", "status", "old_path", "path"])

    return commits.select("cid").mapInPandas(run, "cid string, status string, old_path string, path string")


def kept_files(files: DataFrame, only_python_changes: bool = False) -> DataFrame:
    """``cid, files``: added and changed paths, sorted; optionally changed ones only if they are Python."""
    keep = (F.col("status") == "A") | ((F.col("status") == "M") & (F.col("path").endswith(".py") if only_python_changes else F.lit(True)))
    return files.filter(keep).groupBy("cid").agg(F.array_sort(F.collect_list("path")).alias("files"))


def tree_files(commits: DataFrame, repository: str) -> DataFrame:
    """``cid, path``: all files at each commit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cid in f["cid"]:
                paths = [p for p in run_git(repository, "ls-tree", "-r", "-z", "--name-only", cid).split("\0") if p]
                yield pd.DataFrame({"cid": [cid] * len(paths), "path": paths})

    return commits.select("cid").mapInPandas(run, "cid string, path string")


def diffs(pairs: DataFrame, repository: str) -> DataFrame:
    """``diff_commit, blame_commit, path, diff_text``: patches from ``blame_commit`` to ``diff_commit`` by file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for new, old in zip(f["diff_commit"], f["blame_commit"]):
                text = run_git(repository, "diff", "--no-renames", "--no-color", old, new)
                for piece in re.split(r"(?m)^diff --git .*\n", text)[1:]:
                    m = re.search(r"(?m)^\+\+\+ (?:b/(.*)|/dev/null)$", piece)
                    o = re.search(r"(?m)^--- (?:a/(.*)|/dev/null)$", piece)
                    path = (m and m[1]) or (o and o[1])
                    if path:  # git ends names with blanks by a tab
                        rows.append((new, old, path.rstrip("\t"), piece))
            yield pd.DataFrame(rows, columns=["diff_commit", "blame_commit", "path", "diff_text"])

    return pairs.select("diff_commit", "blame_commit").distinct().mapInPandas(run, "diff_commit string, blame_commit string, path string, diff_text string")


_LINE = re.compile(r"^([0-9a-f]{40}) (\d+) (\d+)(?: \d+)?$")


def blame(requests: DataFrame, repository: str, moves: bool = False) -> DataFrame:
    """``cid, path, start, end`` to ``at, path, cid, lineno, orig_lineno, status``: who wrote the lines of a file at a commit.

    ``start`` and ``end`` bound the lines (both null for the whole file).  A file
    that cannot be blamed gives one row with status ``error`` and null lines, an
    empty one ``empty``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for cid, path, a, b in zip(f["cid"], f["path"], f["start"], f["end"]):
                limit = [f"-L{int(a)},{int(b)}"] if pd.notna(a) and pd.notna(b) else []
                try:
                    text = run_git(repository, "blame", "--porcelain", *(["-C", "-C"] if moves else []), *limit, cid, "--", path)
                except RuntimeError:
                    rows.append((cid, path, None, None, None, "error"))
                    continue
                found = [(cid, path, m[1], int(m[3]), int(m[2]), "ok") for m in map(_LINE.match, text.split("\n")) if m]
                rows += found or [(cid, path, None, None, None, "empty")]
            out = pd.DataFrame(rows, columns=["at", "path", "cid", "lineno", "orig_lineno", "status"])
            out["lineno"], out["orig_lineno"] = out["lineno"].astype("Int64"), out["orig_lineno"].astype("Int64")
            yield out

    wanted = requests.select("cid", "path", F.col("start").cast("int"), F.col("end").cast("int")).distinct()
    return wanted.mapInPandas(run, "at string, path string, cid string, lineno int, orig_lineno int, status string")


def cached_blame(requests: DataFrame, repository: str, cache: DataFrame | None) -> DataFrame:
    """Blame of the lines that a cache lacks, with the cache's own rows; each line of a file counts once.

    Other lines of a file that is in the cache are fetched; files that the cache
    knows as empty or failed are not asked for again.  A cache does not tell
    whether it has a whole file, so requests without range are always made.
    """
    if cache is None:
        return blame(requests, repository)
    from ..operators.ranges import line_runs

    lines = requests.filter("start is not null").select("cid", "path", F.explode(F.sequence("start", "end")).alias("lineno")).distinct()
    known = cache.filter("lineno is not null").select(F.col("at").alias("cid"), "path", "lineno")
    failed = cache.filter("lineno is null").select(F.col("at").alias("cid"), "path")
    missing = lines.join(known, ["cid", "path", "lineno"], "left_anti").join(failed, ["cid", "path"], "left_anti")
    new = line_runs(missing, ["cid", "path"]).select("cid", "path", "start", "end").unionByName(requests.filter("start is null").select("cid", "path", "start", "end"))
    return cache.unionByName(cut(blame(new, repository))).dropDuplicates(["at", "path", "lineno"])


def python_files(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """``path, content``: the files below a folder whose name fits a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("content").cast("string").alias("content"))
