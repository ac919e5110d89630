"""Projections of review records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cast_votes(label: Column) -> Column:
    """The votes of a label that are not zero, as structs of account, name and value; empty for null."""
    votes = F.filter(label["all"], lambda v: v.isNotNull() & (F.coalesce(v["value"], F.lit(0)) != 0))
    return F.coalesce(votes, F.filter(label["all"], lambda v: F.lit(False)))


def kept_labels(labels: Column, names: tuple[str, ...] = ("Workflow", "Verified", "Code-Review")) -> Column:
    """Only the labels that reviews are judged by."""
    return F.map_filter(labels, lambda k, v: k.isin(*names) & v.isNotNull())


def last_revision_messages(messages: Column) -> Column:
    """The messages on the revision of the last numbered message, then those without a number."""
    real = F.filter(messages, lambda m: m.isNotNull())
    numbered = F.filter(real, lambda m: m["_revision_number"].isNotNull())
    last = F.try_element_at(numbered, F.lit(-1))["_revision_number"]
    return F.concat(F.filter(numbered, lambda m: m["_revision_number"] == last), F.filter(real, lambda m: m["_revision_number"].isNull()))


def max_revision(messages: Column) -> Column:
    """The greatest revision number of the messages, null if none has one."""
    return F.array_max(F.transform(F.filter(messages, lambda m: m.isNotNull()), lambda m: m["_revision_number"]))


def vote_sum(label: Column) -> Column:
    """The sum of the votes of a label; 0 without votes."""
    values = F.transform(F.filter(label["all"], lambda v: v.isNotNull()), lambda v: F.coalesce(v["value"], F.lit(0)))
    return F.coalesce(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(0))


def review_features(labels: Column, messages: Column) -> Column:
    """What a review tells about a change: revisions, who approved, votes."""
    code = F.try_element_at(labels, F.lit("Code-Review"))
    flow = F.try_element_at(labels, F.lit("Workflow"))
    return F.struct((labels.isNotNull() | messages.isNotNull()).alias("has_data"), max_revision(messages).alias("revision"), code["approved"]["name"].alias("approved_code"), flow["approved"]["name"].alias("approved_workflow"), vote_sum(code).alias("votes"))
