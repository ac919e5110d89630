"""Line ranges: unified diffs to changed lines, runs of lines, merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, keys: list[str], text: str = "diff_text") -> DataFrame:
    """One row per line of each diff inside a hunk: keys, hunk, its parent range, line position and mark.

    Diffs lead from parent to child, so the parent's lines are those that are
    kept or removed.  A missing length means one line; hunks without parent
    lines are left out, as they have nothing to blame.  Keys name one diff each;
    repeated rows count once.
    """
    # spread by key while they are whole texts: what follows groups by key, and shuffles no lines
    once = diffs.select(*keys, text).repartition(*keys).distinct()
    lines = once.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    head = F.regexp_extract("line", HUNK, 1)
    size = F.regexp_extract("line", HUNK, 2)
    is_head, mark = F.col("line").startswith("@@"), F.substring("line", 1, 1)
    starts = F.when(is_head & (head != ""), head.cast("int"))
    sizes = F.when(is_head, F.coalesce(F.nullif(size, F.lit("")).cast("int"), F.lit(1)))
    named = F.col("line").startswith("--- a/") | F.col("line").startswith("+++ b/")
    read = lines.filter(is_head | mark.isin(" ", "+", "-") & ~named).select(*keys, "at", "line", mark.alias("mark"), is_head.alias("is_head"), starts.alias("starts"), sizes.alias("sizes"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = read.select("*", F.sum(F.col("is_head").cast("int")).over(w).alias("hunk"), F.last("starts", ignorenulls=True).over(w).alias("p_start"), F.last("sizes", ignorenulls=True).over(w).alias("p_len"))
    return whole.filter((F.col("hunk") > 0) & ~F.col("is_head") & (F.col("p_len") > 0)).select(*keys, "hunk", "p_start", "p_len", "at", "mark", "line")


def _touched(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with the parent lines that each of them touches (null for none), and whether it is the first of its hunk."""
    by_hunk = Window.partitionBy(*keys, "hunk").orderBy("at")
    before = by_hunk.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum((F.col("mark") != "+").cast("int")).over(before), F.lit(0))
    # the last removed or kept line before an added one, without added ones in between
    last_other = F.last(F.when(F.col("mark") != "+", F.col("mark")), ignorenulls=True).over(before)
    placed = lines.select("*", (F.col("p_start") + used).alias("p"), last_other.alias("last_other"), (F.count(F.lit(1)).over(before) == 0).alias("is_first"))
    touched = F.when(F.col("mark") == "-", F.array("p")).when((F.col("mark") == "+") & (F.col("last_other") == "-"), F.array(F.col("p") - 1)).when(F.col("mark") == "+", F.array(F.col("p") - 1, F.col("p")))
    return placed.withColumn("touched", touched)


def change_seeds(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lineno``: parent lines that a diff touches.

    A removed line touches itself, an added one the lines before and after the
    place of insertion; an added line right after removed ones touches only the
    last of these.
    """
    return _touched(lines, keys).filter("touched is not null").select(*keys, F.explode("touched").alias("lineno")).distinct()


def proximity(lines: DataFrame, keys: list[str], limit: int = 4) -> DataFrame:
    """``keys, lineno, proximity``: parent lines of the hunks within ``limit - 1`` lines of a change; a changed line has 1.

    Each hunk gives its parent lines, each touched line those around it; grouped
    by line, the ones that have both are left.  A join of the two would be planned
    as a broadcast: nothing tells how many lines a text has, so its size is
    estimated as that of a few numbers for each diff.
    """
    offsets = F.sequence(F.lit(1 - limit), F.lit(limit - 1))
    start = F.col("p_start").cast("bigint")
    whole = F.transform(F.sequence(start, start + F.col("p_len") - 1), lambda n: F.struct(n.alias("lineno"), F.lit(None).cast("int").alias("near")))
    rings = F.flatten(F.transform("touched", lambda n: F.transform(offsets, lambda off: F.struct((n + off).alias("lineno"), (F.abs(off) + 1).alias("near")))))
    marks = _touched(lines, keys).select(*keys, F.explode(F.array(F.when(F.col("is_first"), whole), rings)).alias("marks")).select(*keys, F.inline("marks"))
    by_line = marks.groupBy(*keys, "lineno").agg(F.min("near").alias("proximity"), F.bool_or(F.col("near").isNull()).alias("in_hunk"))
    return by_line.filter("in_hunk and proximity is not null").drop("in_hunk")


def line_runs(lines: DataFrame, keys: list[str], line: str = "lineno") -> DataFrame:
    """``keys, start, end``: runs of consecutive lines; repeated lines count once."""
    w = Window.partitionBy(*keys).orderBy(line)
    numbered = lines.select(*keys, line).distinct().withColumn("_island", F.col(line) - F.row_number().over(w))
    return numbered.groupBy(*keys, "_island").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_island")


def merge_ranges(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys, start, end``: ranges with overlapping and adjacent ones merged; a range within another adds nothing."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.withColumn("_reach", F.max(end).over(w)).withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + 1)).cast("int"))
    island = first.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def range_lines(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys, lineno``: the lines of ranges; empty ranges have none."""
    return ranges.filter(F.col(start) <= F.col(end)).select(*keys, F.explode(F.sequence(start, end)).alias("lineno")).distinct()


def lines_of_code(diff_text: Column) -> Column:
    """``struct<add, remove, change>`` of one file's diff: added and removed lines, and the greater of both."""
    rows = F.split(diff_text, "\n")
    add = F.size(F.filter(rows, lambda x: x.startswith("+") & ~x.startswith("+++ ")))
    remove = F.size(F.filter(rows, lambda x: x.startswith("-") & ~x.startswith("--- ")))
    return F.struct(add.alias("add"), remove.alias("remove"), F.greatest(add, remove).alias("change"))


def commit_loc(diffs: DataFrame, cid: str = "cid", path: str = "path", text: str = "diff_text") -> DataFrame:
    """``cid, loc_add, loc_change, loc_detail``: sums over the files of each commit, and a map by file."""
    per_file = diffs.select(cid, path, lines_of_code(F.col(text)).alias("d"))
    return per_file.groupBy(cid).agg(F.sum("d.add").alias("loc_add"), F.sum("d.change").alias("loc_change"), F.map_from_entries(F.collect_list(F.struct(F.col(path), F.struct(F.col("d.add"), F.col("d.change").alias("changes"))))).alias("loc_detail"))
