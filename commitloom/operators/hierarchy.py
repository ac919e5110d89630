"""Parent-child links of unknown depth to full hierarchies.

A frontier of solved nodes grows from the roots.  Joining it level by level
would take as many rounds as the deepest node has ancestors, so each unsolved
node keeps a pointer that doubles its reach every round: after round k the
frontier holds all nodes of depth below 2**k, and a node whose pointer meets it
is solved with all levels in between.  Nodes that no round reaches hang on a
cycle; there, pointers that reach further than there are such nodes end on the
cycle itself and carry its smallest key.

The rounds work on numbers that stand for the keys, in their order.  Paths are
made of segments of at most SEGMENT nodes, which grow below every SEGMENT-th
level at once; only the nodes of those levels carry longer parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import current_rows, cut, cut_round, undeleted, written

#: Levels of a hierarchy that one segment of a path spans.
SEGMENT = 16


def commit_links(commits: DataFrame) -> DataFrame:
    """``node, parent`` of each commit whose current row is undeleted.

    The parent is the commit named by the first entry of ``parents``, in any
    letter case; null if that is lacking, null, blank or names no such commit.
    """
    slim = commits.select("cid", F.try_element_at("parents", F.lit(1)).alias("up"), "ingested_at", "tombstone")
    live = undeleted(current_rows(slim, ["cid"], tie=["up"])).filter(F.col("cid").isNotNull())
    named = live.groupBy(F.lower("cid").alias("k")).agg(F.min("cid").alias("parent"))
    return live.select(F.col("cid").alias("node"), F.lower(F.trim("up")).alias("k")).join(named, "k", "left").select("node", "parent")


def _numbered(links: DataFrame) -> DataFrame:
    """``id, node, parent_id``: a number for each node, in the order of the keys, and that of its parent (null where that is no node)."""
    base = links.groupBy("node").agg(F.min("parent").alias("parent")).filter(F.col("node").isNotNull())
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(base.repartitionByRange(parts, "node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()))
    return cut(ids.join(ids.select(F.col("node").alias("parent"), F.col("id").alias("parent_id")), "parent", "left").select("id", "node", "parent_id"))


def _solve(nodes: DataFrame) -> DataFrame:
    """``id, root, depth`` of ``id, parent_id``, by pointers that double their reach."""
    start = nodes.select("id", F.when(F.col("parent_id").isNull(), F.col("id")).alias("root"), F.when(F.col("parent_id").isNull(), 0).cast("int").alias("depth"), F.col("parent_id").alias("anc"), F.lit(1).alias("dist"), F.col("id").alias("least"))
    done, open_, reach, stuck = [start.filter("root is not null")], cut(start.filter("root is null")), 1, False
    left = open_.count()
    while left and not (stuck and reach >= left):
        # what a pointer meets: a solved node with its root and depth, or another open one with its own pointer
        solved = reduce(DataFrame.unionAll, done).select(F.col("id").alias("anc"), F.col("root").alias("r_root"), F.col("depth").alias("r_depth"), F.lit(None).cast("bigint").alias("r_anc"), F.lit(0).alias("r_dist"), F.lit(None).cast("bigint").alias("r_least"))
        onward = open_.select(F.col("id").alias("anc"), F.lit(None).cast("bigint").alias("r_root"), F.lit(None).cast("int").alias("r_depth"), F.col("anc").alias("r_anc"), F.col("dist").alias("r_dist"), F.col("least").alias("r_least"))
        state = cut_round(
            open_.join(solved.unionAll(onward), "anc").select(
                "id",
                F.col("r_root").alias("root"),
                (F.col("r_depth") + F.col("dist")).cast("int").alias("depth"),
                F.col("r_anc").alias("anc"),
                (F.col("dist") + F.col("r_dist")).cast("int").alias("dist"),
                F.least("least", "r_least").alias("least"),
            )
        )
        done.append(state.filter("root is not null"))
        open_ = state.filter("root is null")
        before, left, reach = left, open_.count(), reach * 2
        stuck = before == left
    if left:
        on_cycle = open_.select(F.col("id").alias("anc"), F.col("least").alias("r_least"))
        done.append(open_.join(on_cycle, "anc").select("id", F.col("r_least").alias("root"), F.lit(-1).alias("depth"), "anc", "dist", "least"))
    return reduce(DataFrame.unionAll, done).select("id", "root", "depth")


def hierarchy(links: DataFrame) -> DataFrame:
    """``node, parent, root, depth`` of each node.

    ``links`` has one row per node; a null parent, or one that is no node, makes
    a root of depth 0.  On a cycle and below it ``root`` is the smallest node of
    that cycle and ``depth`` -1.  Repeated rows of a node count once (the
    smallest parent).  No links give no rows.

    Each round is one join of the nodes not yet solved with all nodes, so the
    work is the number of nodes times the logarithm of the greatest depth; the
    join side has one row per node, so a parent with very many children is a
    skewed probe side only, which adaptive execution splits.
    """
    nodes = _numbered(links)
    solved = _solve(nodes)
    rows = nodes.join(solved, "id")
    names = nodes.select(F.col("id").alias("root"), F.col("node").alias("root_node"))
    tops = names.join(solved.select("root").distinct(), "root", "left_semi")
    above = nodes.select(F.col("id").alias("parent_id"), F.col("node").alias("parent"))
    return rows.join(tops, "root").join(above, "parent_id", "left").select("node", "parent", F.col("root_node").alias("root"), "depth")


def _segments(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """``id, depth, anchor, seg``: each solved node with the nearest node above it (or itself) whose depth is a multiple of SEGMENT, and the keys from that node down to it.

    Below all anchors at once segments double their length each round, so there
    are as many joins as the logarithm of SEGMENT, whatever the depth.
    """
    placed = nodes.join(depths.filter("depth >= 0"), "id")
    top = F.col("depth") % SEGMENT == 0
    state = written(placed.select("id", "depth", F.when(top, F.col("id")).alias("anchor"), F.when(~top, F.col("parent_id")).alias("anc"), F.array("node").alias("seg")))
    done, open_ = [state.filter("anc is null")], state.filter("anc is not null")
    for _ in range(SEGMENT.bit_length() - 1):
        other = reduce(DataFrame.unionAll, [*done, open_]).select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("anchor").alias("top"), F.col("seg").alias("up"))
        state = written(open_.join(other, "anc").select("id", "depth", F.col("top").alias("anchor"), F.col("next").alias("anc"), F.concat("up", "seg").alias("seg")))
        done.append(state.filter("anc is null"))
        open_ = state.filter("anc is not null")
    return reduce(DataFrame.unionAll, done).select("id", "depth", "anchor", "seg")


def _anchor_links(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``anchor, up``: the anchor above each anchor (null for roots), the one of its parent."""
    tops = segments.filter(F.col("id") == F.col("anchor")).select("anchor").join(nodes.select(F.col("id").alias("anchor"), "parent_id"), "anchor")
    return tops.join(segments.select(F.col("id").alias("parent_id"), F.col("anchor").alias("up")), "parent_id", "left").select("anchor", "up")


def paths(links: DataFrame) -> DataFrame:
    """``node, path, depth``: the keys from the root to each node, itself included; null path and depth -1 on and below cycles.

    The part of a path down to the last anchor is made once per anchor, by parts
    that double their length, and met by the nodes of that anchor where they
    are; so what is shuffled is the segments of all nodes and the paths of the
    anchors, one node in SEGMENT.
    """
    nodes = _numbered(links)
    depths = written(_solve(nodes))
    segments = _segments(nodes, depths)
    up = written(_anchor_links(segments, nodes))
    whole = segments.select(F.col("id").alias("up"), "anchor", "seg")
    # above: the keys over an anchor, from the anchor ``rest`` (exclusive, null for the root) down to its parent
    above = up.join(nodes.select(F.col("id").alias("anchor"), "parent_id"), "anchor").join(whole.select(F.col("up").alias("parent_id"), "seg"), "parent_id", "left")
    state = written(above.select("anchor", "up", F.coalesce("seg", F.array().cast(nodes.select(F.array("node")).schema[0].dataType)).alias("above")))
    done, open_ = [state.filter("up is null")], state.filter("up is not null")
    while open_.limit(1).count():
        other = reduce(DataFrame.unionAll, [*done, open_]).select(F.col("anchor").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"))
        state = written(open_.join(other, "up").select("anchor", F.col("next").alias("up"), F.concat("more", "above").alias("above")))
        done.append(state.filter("up is null"))
        open_ = state.filter("up is not null")
    tops = reduce(DataFrame.unionAll, done).select("anchor", "above")
    found = segments.join(tops, "anchor").select("id", F.concat("above", "seg").alias("path"))
    return nodes.join(depths, "id").join(found, "id", "left").select("node", "path", "depth")


def descendants(links: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance``: one row per pair of a node and a node below it.

    A node is no descendant of itself.  Nodes on or below a cycle give no pairs.
    Pairs of an anchor and what stands above it grow from its parent's segment
    and, round by round, from the pairs of the anchors above, as rows; each node
    then has the pairs of its anchor and those of its own segment.  No task holds
    a whole path or the descendants of a whole tree.
    """
    nodes = _numbered(links)
    segments = _segments(nodes, written(_solve(nodes)))
    up = written(_anchor_links(segments, nodes))
    keys = segments.select("id", "anchor", "depth", F.element_at("seg", -1).alias("node"), "seg")
    own = keys.select(F.col("node").alias("descendant"), F.posexplode("seg").alias("pos", "ancestor"), F.size("seg").alias("n")).filter("pos < n - 1").select("ancestor", "descendant", (F.col("n") - 1 - F.col("pos")).alias("distance"))
    # reach: chains of anchors that are exactly ``step`` links apart; above: all anchors over an anchor, fewer than ``step`` away
    step = 1
    reach = up.filter("up is not null").select("anchor", "up")
    above = up.select("anchor", F.col("anchor").alias("top"), F.lit(0).alias("hops"))
    while reach.limit(1).count():
        further = above.select(F.col("anchor").alias("up"), "top", "hops").join(reach, "up").select("anchor", "top", (F.col("hops") + step).alias("hops"))
        above = written(above.unionByName(further))
        reach, step = written(reach.join(reach.select(F.col("anchor").alias("up"), F.col("up").alias("next")), "up").select("anchor", F.col("next").alias("up"))), 2 * step
    # every anchor stands SEGMENT levels below the one above; what lies between is the segment of its parent
    parents = up.filter("up is not null").join(nodes.select(F.col("id").alias("anchor"), "parent_id"), "anchor").join(segments.select(F.col("id").alias("parent_id"), "seg"), "parent_id").select(F.col("anchor").alias("top"), "seg")
    over = above.join(parents, "top").select("anchor", "hops", F.posexplode("seg").alias("pos", "ancestor"))
    over = over.select("anchor", "ancestor", (F.col("hops") * SEGMENT + (SEGMENT - F.col("pos"))).alias("far"))
    rest = keys.select("anchor", F.col("node").alias("descendant"), (F.size("seg") - 1).alias("below")).join(over, "anchor").select("ancestor", "descendant", (F.col("below") + F.col("far")).cast("int").alias("distance"))
    return own.select("ancestor", "descendant", F.col("distance").cast("int").alias("distance")).unionByName(rest)


def contradicted(tree: DataFrame, recorded: DataFrame) -> DataFrame:
    """``node, depth, recorded``: nodes of trees whose recorded distance to the mainline is not the true one.

    ``recorded`` has ``node, recorded, actual``; unknown (null) distances contradict nothing.
    """
    side = tree.filter("depth >= 0").join(recorded.filter("recorded is not null and actual is not null and recorded <> actual"), "node")
    return side.select("node", "depth", "recorded")
