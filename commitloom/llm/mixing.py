"""Mixtures of sources with target shares, by Pareto order sampling.

Every document of a source gets the expected number of copies that makes the
source reach its target: the whole copies are certain, and the fraction left is
the inclusion probability of one more.  Those extra copies are drawn as a Pareto
order sample: documents are ranked by their random odds divided by their
inclusion odds and taken in that order until the tokens left are filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .tokens import VOCABULARY, count_tokens

#: Sources up to which the plan is sent to every task; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 10_000
#: Slices of the ranking of a source that are summed before one of them is sorted.
SLICES = 4096


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on nothing but key and seed."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source of ``targets``: tokens there are, tokens wanted, and copies of each token.

    ``total_tokens`` is the size of the mixture; None means the greatest at which
    every source that has tokens can give its share within ``max_repeats``.  A
    source without tokens can give nothing and does not shrink the others; a
    source that cannot reach its share of a given total gives all it may.
    Targets with null source, no positive share or no repeats want nothing.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count_if(F.col("n_tokens") > 0).alias("documents"))
    wanted = targets.filter("source is not null").groupBy("source").agg(F.greatest(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    rows = wanted.join(have, "source", "left").fillna(0, ["available", "documents", "max_repeats"]).fillna(0.0, ["target_share"])
    able = F.when((F.col("target_share") > 0) & (F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    if total_tokens is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.min(able), F.lit(0.0)).alias("total"))))  # one row
    else:
        rows = rows.withColumn("total", F.lit(total_tokens).cast("double"))
    want = F.least(F.col("total") * F.col("target_share"), (F.col("available") * F.col("max_repeats")).cast("double"))
    return rows.withColumn("wanted", want).withColumn("rate", F.when(F.col("available") > 0, F.col("wanted") / F.col("available")).otherwise(0.0))


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, total_tokens: int | None = None, seed: int = 0, weight_col: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: how often each document is used; unused ones are left out.

    Documents of sources without target, with null source, or without tokens are
    not used.  ``weight_col`` makes the inclusion unequal: a document's expected
    copies are proportional to its weight (null and negative weights count as
    0), cut at ``max_repeats``.  No document is used more often than
    ``max_repeats`` of its source.  The last document that is drawn is the one
    that brings the source closest to its tokens, so a source misses its target
    by at most half a document.  The same input, parameters and seed give the
    same mixture.  Rows of one id are one document (the longest of them), rows
    without id are none.

    A source may hold most of the documents: its ranking is never sorted as a
    whole.  The tokens of fixed slices of it are summed first, and only the
    slice in which the target is reached is sorted.
    """
    extra = [weight_col] if weight_col else []
    slim = documents.filter(F.col("source").isNotNull())
    counted = count_tokens(slim, ["doc_id", "source", *extra], path=path)
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    once = counted.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source", weight.alias("w"))).alias("d"))
    sizes = cut(once.select("doc_id", "d.source", "d.n_tokens", "d.w"))
    goals = cut(plan(sizes, targets, total_tokens))
    mass = sizes.groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens")).alias("mass"), F.max("w").alias("w_max"))
    per_source = goals.join(mass, "source").select("source", "wanted", "max_repeats", "mass")
    # expected copies, whole copies, chance of one more
    small = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    drawn = sizes.join(F.broadcast(per_source) if small else per_source, "source").filter("n_tokens > 0 and mass > 0")
    expected = F.least(F.col("wanted") * F.col("w") / F.col("mass"), F.col("max_repeats").cast("double"))
    drawn = drawn.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("int")).withColumn("pi", F.col("expected") - F.col("whole"))
    u = uniform(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("n_tokens").cast("string")), seed)
    odds = F.when((F.col("pi") > 1e-9) & (F.col("whole") < F.col("max_repeats")), (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi"))))
    ranked = drawn.withColumn("q", odds).withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES).cast("int"))
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("certain"))
    sums = ranked.filter("q is not null").groupBy("source", "slice").agg(F.sum("n_tokens").alias("s"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sums.withColumn("before", F.coalesce(F.sum("s").over(ahead), F.lit(0))).join(certain, "source").join(per_source.select("source", "wanted"), "source")
    slices = cut(slices.select("source", "slice", "before", "s", (F.col("wanted") - F.col("certain")).alias("need")))
    # slices wholly within the need are taken, the one that crosses it is sorted
    placed = ranked.join(slices, ["source", "slice"], "left")
    crossing = placed.filter("need is not null and before < need and before + s > need")
    order = Window.partitionBy("source", "slice").orderBy("q", "doc_id", "n_tokens")
    some = crossing.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    some = some.withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("need")).cast("int")).drop("upto")
    rest = placed.filter("need is null or before >= need or before + s <= need").withColumn("more", F.coalesce((F.col("before") + F.col("s") <= F.col("need")).cast("int"), F.lit(0)))
    out = rest.unionByName(some).withColumn("copies", F.col("whole") + F.col("more"))
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: target share, tokens and share reached, documents used and most copies of one."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    every = got.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("tokens").alias("every"))  # one row
    return rows.crossJoin(F.broadcast(every)).withColumn("share", F.round(F.col("tokens") / F.nullif("every", F.lit(0)), 6)).drop("every")
