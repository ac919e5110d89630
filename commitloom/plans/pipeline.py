"""The whole way from raw tables to a data set for prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import actor_email, actor_name, blueprint
from ..ml import features as feat
from ..ml.evaluate import kth_largest
from ..operators import graph, joins, ordering
from ..runtime import current_rows, cut, undeleted


def combined_commits(commits: DataFrame, bugs: DataFrame, changes: DataFrame, details: DataFrame) -> DataFrame:
    """Current commits with the bugs and the review that go with them."""
    now = undeleted(current_rows(commits, ["cid"]))
    bugs_now = undeleted(current_rows(bugs, ["id"]))
    return joins.join_with_reviews(joins.join_with_bugs(now, bugs_now), undeleted(changes), undeleted(details))


def annotate(commits: DataFrame) -> DataFrame:
    """Blueprints, cherry picks and standard actors."""
    picks = joins.cherry_picks(commits).withColumnRenamed("picked_from", "cherry_picked_from")
    actors = commits.select(F.col("author").alias("actor"), F.col("date").alias("at")).unionAll(commits.select(F.col("committer"), F.col("date"))).filter("actor is not null")
    alias = graph.actor_aliases(actors.select("actor", actor_name(F.col("actor")).alias("name"), actor_email(F.col("actor")).alias("email"), "at"))
    out = commits.withColumn("blueprint", F.when(F.col("on_master_branch"), blueprint(F.col("msg")))).join(picks, "cid", "left")
    return out.join(alias.select(F.col("actor").alias("author"), F.col("standard_actor").alias("standard_author")), "author", "left")


def ordered(commits: DataFrame) -> DataFrame:
    """Reachable commits with their overall and author order."""
    rows = cut(ordering.dense_order(commits.filter("date is not null"), ["date", "cid"]))
    return ordering.order_within(rows, ["standard_author"], ["order"], "author_order")


def data_set(commits: DataFrame, scores: DataFrame, fixes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scaled features, labels of commits that reach the score which as many commits as there are fixes reach, and the fitted vocabulary.

    The search counts commits at or above a score, so labels do too; strictly
    above it there would be fewer than there are fixes wherever scores tie.
    """
    scored = commits.join(scores, "cid", "left").fillna(0.0, ["guilt"])
    long = cut(feat.commit_features(scored))
    fitted = cut(feat.fit(long))
    labels = scored.crossJoin(F.broadcast(kth_largest(scored, "guilt", fixes))).select("cid", "order", (F.col("guilt") >= F.col("threshold")).cast("int").alias("label"))
    return feat.transform(long, fitted), labels, fitted
