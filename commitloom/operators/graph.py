"""The commit graph: mainline, first mainline ancestors, side branches, samples, reachability, aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, cut_round


def first_parents(commits: DataFrame) -> DataFrame:
    """``node, parent`` by the first parent, null where there is none."""
    return commits.select(F.col("cid").alias("node"), F.try_element_at("parents", F.lit(1)).alias("parent"))


def walk_to(links: DataFrame, stops: DataFrame) -> DataFrame:
    """``node, stop, distance``: the first stop on the way up from each node (itself at distance 0), null if there is none.

    ``links`` has ``node, parent``, ``stops`` has ``node``.  Pointers double each
    round, so the rounds are the logarithm of the longest way; ways into cycles
    or to unknown parents end with null.
    """
    marks = stops.select("node").distinct().withColumn("stops", F.lit(True))
    base = links.groupBy("node").agg(F.min("parent").alias("parent")).join(marks, "node", "left")
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = base.join(known, "parent", "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    state = cut(base.select("node", F.when(F.col("stops"), F.col("node")).alias("stop"), F.when(F.col("stops"), 0).cast("int").alias("distance"), F.when(F.col("stops").isNull(), F.col("parent")).alias("anc"), F.lit(1).alias("step")))
    done, open_ = [state.filter("anc is null")], state.filter("anc is not null")
    left, rounds = open_.count(), 0
    while left and (1 << rounds) <= 2 * left + (1 << 20):
        other = reduce(DataFrame.unionAll, [*done, open_]).select(F.col("node").alias("anc"), F.col("stop").alias("o_stop"), F.col("distance").alias("o_distance"), F.col("anc").alias("o_anc"), F.col("step").alias("o_step"))
        state = cut_round(open_.join(other, "anc").select("node", F.col("o_stop").alias("stop"), (F.col("o_distance") + F.col("step")).cast("int").alias("distance"), F.col("o_anc").alias("anc"), (F.col("step") + F.coalesce(F.when(F.col("o_anc").isNotNull(), F.col("o_step")), F.lit(0))).cast("int").alias("step")))
        done.append(state.filter("anc is null"))
        open_ = state.filter("anc is not null")
        before, left, rounds = left, open_.count(), rounds + 1
        if before == left and (1 << rounds) > left:
            break  # what is left runs in circles
    done.append(open_.select("node", "stop", "distance", "anc", "step"))
    return reduce(DataFrame.unionAll, done).select("node", "stop", "distance")


def mainline(links: DataFrame, heads: DataFrame) -> DataFrame:
    """``node, position``: the first-parent chain of each head, the head at position 0.

    The chain is walked against the links: a node is on the mainline if a head
    reaches it by first parents, so the positions come from doubling the reach
    of the heads.
    """
    reach = cut(links.filter("parent is not null").select("node", "parent", F.lit(1).alias("step")))
    found = cut(heads.select("node").distinct().withColumn("position", F.lit(0)))
    while True:
        nxt = cut_round(found.join(reach, "node").select(F.col("parent").alias("node"), (F.col("position") + F.col("step")).alias("position")))
        merged = cut_round(found.unionByName(nxt).groupBy("node").agg(F.min("position").alias("position")))
        if merged.count() == found.count():
            return merged
        found = merged
        up = reach.select(F.col("node").alias("parent"), F.col("parent").alias("p2"), F.col("step").alias("s2"))
        reach = cut_round(reach.join(up, "parent").select("node", F.col("p2").alias("parent"), (F.col("step") + F.col("s2")).alias("step")))


def branch_closure(merges: DataFrame, parents: DataFrame, main: DataFrame) -> DataFrame:
    """``merge, node, depth``: the commits that a merge brought in, with their greatest distance from it (1 for its second parent).

    ``merges`` has ``merge, node`` (the second parent), ``parents`` has ``child,
    parent``, ``main`` has ``node``.  Side branches of any length are walked to
    their end: the reach doubles each round, so the rounds are the logarithm of
    the longest path.  Rows are distinct per merge and node, so diamonds cost no
    more than chains; depth is that of the longest path, and null on and below
    cycles, where paths have no end.
    """
    marks = main.select("node").distinct()
    sides = parents.join(marks.withColumnRenamed("node", "parent"), "parent", "left_anti").join(marks.withColumnRenamed("node", "child"), "child", "left_anti")
    reach = cut(sides.select(F.col("child").alias("node"), "parent").distinct())  # pairs that are exactly ``step`` links apart
    found, step = cut(merges.select("merge", "node").join(marks, "node", "left_anti").distinct().withColumn("depth", F.lit(1))), 1  # paths of fewer than ``step`` links
    while True:
        nodes = found.select("node").distinct().count()
        if step > 2 * nodes:  # no path without a cycle has as many links as there are nodes, every cycle has gone round by now
            return found.withColumn("depth", F.when(F.col("depth") <= nodes, F.col("depth")))
        further = cut_round(found.join(reach, "node").groupBy("merge", F.col("parent").alias("node")).agg((F.max("depth") + step).alias("depth")))
        if not further.limit(1).count():
            return found
        found = cut_round(found.unionByName(further).groupBy("merge", "node").agg(F.max("depth").alias("depth")))
        up = reach.select(F.col("node").alias("parent"), F.col("parent").alias("p2"))
        reach, step = cut_round(reach.join(up, "parent").select("node", F.col("p2").alias("parent")).distinct()), 2 * step


def closure_summary(closure: DataFrame, commits: DataFrame) -> DataFrame:
    """Per merge: distinct authors, committers and change ids, commits with changes, most parents, depth."""
    side = closure.join(commits.select(F.col("cid").alias("node"), "author", "committer", "change_id", "parents"), "node")
    return side.groupBy("merge").agg(F.count_distinct("author").alias("authors"), F.count_distinct("committer").alias("committers"), F.count_distinct("change_id").alias("changes"), F.count_if(F.col("change_id").isNotNull()).alias("commits_with_changes"), F.max(F.size("parents")).alias("most_parents"), F.max("depth").alias("depth"))


def sample_mainline(positions: DataFrame, every: int = 100) -> DataFrame:
    """Every n-th node of a mainline, its head, and the node before its end; ``positions`` has ``node, position``."""
    last = positions.agg(F.max("position").alias("last"))
    return positions.crossJoin(F.broadcast(last)).filter((F.col("position") % every == 0) | (F.col("position") == F.col("last") - 1)).select("node", "position").distinct()


def reachable(samples: DataFrame, blame: DataFrame) -> DataFrame:
    """``cid``: commits that still have lines at one of the sampled commits; ``blame`` has ``at, cid``."""
    return blame.join(samples.select(F.col("node").alias("at")), "at", "left_semi").select("cid").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: connected components of undirected edges ``a, b``, named by their least node.

    Least labels spread along edges and are shortened by the label's own label
    each round, so long chains need few rounds.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("l")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        hop = label.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        new = label.join(near, "node").join(hop, "l", "left").select("node", F.least("l", "m", F.coalesce("ll", "l")).alias("n"), "l")
        new = cut_round(new)
        moved = new.filter("n <> l").limit(1).count()
        label = new.select("node", F.col("n").alias("l"))
        if not moved:
            return label.select("node", F.col("l").alias("component"))


def actor_aliases(actors: DataFrame, name: str = "name", email: str = "email", actor: str = "actor", at: str = "at") -> DataFrame:
    """``actor, standard_actor``: actors with the same name or email, through any chain, are one; the latest stands for all.

    Blank and null names and emails connect nobody.
    """
    rows = actors.select(F.col(actor).alias("actor"), F.lower(F.trim(F.col(name))).alias("n"), F.lower(F.trim(F.col(email))).alias("e"), F.col(at).alias("at"))
    slim = cut(rows.groupBy("actor", "n", "e").agg(F.max("at").alias("at")))
    edges = slim.filter("n <> ''").select(F.concat(F.lit("a:"), "actor").alias("a"), F.concat(F.lit("n:"), "n").alias("b")).unionAll(slim.filter("e <> ''").select(F.concat(F.lit("a:"), "actor").alias("a"), F.concat(F.lit("e:"), "e").alias("b")))
    comp = components(edges.distinct())
    own = slim.groupBy("actor").agg(F.max("at").alias("at")).withColumn("node", F.concat(F.lit("a:"), "actor")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stands = own.groupBy("component").agg(F.max_by("actor", F.struct("at", "actor")).alias("standard_actor"))
    return own.join(stands, "component").select("actor", "standard_actor")


def nearest_mainline(closure: DataFrame) -> DataFrame:
    """``node, merge``: the merge that brought a side commit in at the least depth (one without end comes last)."""
    w = Window.partitionBy("node").orderBy(F.col("depth").asc_nulls_last(), "merge")
    return closure.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("node", "merge")


def gather_into(closure: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """``merge, value``: the distinct values (bugs, changes) of the commits that a merge brought in, as rows."""
    return nearest_mainline(closure).join(links.select(F.col("cid").alias("node"), value), "node").select("merge", value).distinct()
