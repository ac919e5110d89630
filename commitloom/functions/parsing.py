"""Parsing of commit messages, actors and paths as Column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns, F.lit(False))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def actor_name(actor: Column) -> Column:
    """The name in ``<git.Actor "Name <email>">``, trimmed; null if the form is another."""
    name = F.trim(F.regexp_extract(actor, r'(?s)"(.*)<[^<>]*>', 1))
    return F.when(actor.rlike(r'(?s)".*<[^<>]*>'), name)


def actor_email(actor: Column) -> Column:
    """The email in ``<git.Actor "Name <email>">``, trimmed; null if the form is another."""
    email = F.trim(F.regexp_extract(actor, r'(?s)".*<([^<>]*)>', 1))
    return F.when(actor.rlike(r'(?s)".*<[^<>]*>'), email)


def quoted_name(actor: Column) -> Column:
    """The text between the first two double quotes, null if there is none."""
    return F.nullif(F.regexp_extract(actor, r'"([^"]*)"', 1), F.lit(""))


def same_actor(author: Column, committer: Column, relaxed: bool = True) -> Column:
    """Whether two actors are one: equal in lower case, or (relaxed) with equal name or equal email."""
    exact = F.lower(author) == F.lower(committer)
    if not relaxed:
        return exact
    return exact | F.coalesce(F.lower(actor_name(author)) == F.lower(actor_name(committer)), F.lit(False)) | F.coalesce(F.lower(actor_email(author)) == F.lower(actor_email(committer)), F.lit(False))


def contains_any(field: Column, names: list[str]) -> Column:
    """Whether ``field`` contains one of ``names``; false for null."""
    return F.coalesce(_any([field.contains(n) for n in names]), F.lit(False))


def author_address(actor: Column) -> Column:
    """The address of an author: the email in brackets, else what looks like one after a quote, else the first quoted word."""
    forms = [r"<(\S+@\S+)>", r'"(\S+@\S+)\s', r'"(\S+)\s']
    found = F.coalesce(*[F.nullif(F.regexp_extract(actor, f, 1), F.lit("")) for f in forms])
    return F.regexp_replace(found, '>"$', "")


def author_org(actor: Column) -> Column:
    """What follows the last @ of the address."""
    return F.substring_index(author_address(actor), "@", -1)


def change_ids(message: Column) -> Column:
    """All change ids of lines that begin with "change", in order."""
    lines = F.filter(_lines(message), lambda x: F.lower(x).startswith("change") & x.rlike(K.CHANGE_ID))
    return F.transform(lines, lambda x: F.regexp_extract(x, K.CHANGE_ID, 1))


def change_id(message: Column) -> Column:
    """The last change id of the message, null if there is none."""
    return F.try_element_at(change_ids(message), F.lit(-1))


def bug_ids(message: Column) -> Column:
    """The distinct numbers of the bugs that a message says it fixes, sorted; empty if none, null for null."""

    def fixes(x: Column) -> Column:
        start = _any([x.startswith(s) for s in K.BUG_ACCEPT_START])
        reject = _any([x.contains(s) for s in K.BUG_REJECT])
        accept = _any([x.contains(s) for s in K.BUG_ACCEPT])
        return x.contains("bug") & (start | (~reject & accept))

    lines = F.filter(_lines(F.lower(message)), fixes)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(K.BUG_NUMBER), F.lit(1))))))


def blueprint(message: Column, host: str = "//blueprints.") -> Column:
    """The blueprint that a message names, in lower case, null if none.

    First lines with "blueprint" are read (the last part of an address on
    ``host``, else the word at the line's end), then lines with "bp".
    """
    lines = F.filter(F.split(F.lower(message), r"\r\n|\n|\r"), lambda x: x.contains("bp") | x.contains("blueprint"))

    def word(x: Column, mark: str) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_extract(x, mark + r":?\s*(\S+)$", 1), r"\.$", ""), F.lit(""))

    first = F.transform(F.filter(lines, lambda x: x.contains("blueprint")), lambda x: F.when(x.contains(host), F.nullif(F.substring_index(x, "/", -1), F.lit(""))).otherwise(word(x, "blueprint")))
    second = F.transform(F.filter(lines, lambda x: x.contains("bp")), lambda x: word(x, "bp"))
    return F.coalesce(F.try_element_at(F.filter(first, lambda x: x.isNotNull()), F.lit(1)), F.try_element_at(F.filter(second, lambda x: x.isNotNull()), F.lit(1)))


def cherry_picked_from(message: Column) -> Column:
    """The commit that a message says it was picked from, null if none."""
    return F.when(message.contains("cherry"), F.nullif(F.regexp_extract(message, K.CHERRY_PICK, 1), F.lit("")))


def parse_message(message: Column) -> Column:
    """``struct<change_id, bugs>``: what a message says about changes and bugs."""
    return F.struct(change_id(message).alias("change_id"), bug_ids(message).alias("bugs"))


def analysed_file(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path is analysed: no excluded prefix, and one of the included suffixes."""
    inc, exc = include or K.INCLUDE_SUFFIXES, exclude if exclude is not None else K.EXCLUDE_PREFIXES
    return ~_any([path.startswith(p) for p in exc]) & _any([path.endswith(s) for s in inc])


def valid_blob(sha: Column) -> Column:
    """Whether a blob id names a blob: neither null nor all zeros."""
    return sha.isNotNull() & ~sha.rlike("^0+$")


def message_class(message: Column) -> Column:
    """Marks of a message: struct of merge_pull_request, merge_branch, bug, fix, issue, number."""
    low = F.lower(message)
    return F.struct(low.contains("merge pull request #").alias("merge_pull_request"), low.startswith("merge branch").alias("merge_branch"), low.contains("bug").alias("bug"), low.contains("fix").alias("fix"), low.contains("issue").alias("issue"), low.contains("#").alias("number"))


def tracker_links(content: Column, commit_urls: list[str]) -> Column:
    """``struct<change_id, cid>`` of a tracker message, null unless both are found; of several the last counts.

    ``commit_urls`` are the beginnings of commit addresses; the id is what
    follows their last ``/`` or ``=``.
    """
    lines = _lines(content)
    changes = F.transform(F.filter(lines, lambda x: x.contains("Change-Id: I")), lambda x: F.trim(F.substring_index(x, ":", -1)))
    commits = F.filter(lines, lambda x: ~x.contains("Change-Id: I") & _any([x.contains(u) for u in commit_urls]))
    cids = F.transform(commits, lambda x: F.regexp_extract(x, r"([^/=]*)$", 1))
    pair = F.struct(F.try_element_at(changes, F.lit(-1)).alias("change_id"), F.try_element_at(cids, F.lit(-1)).alias("cid"))
    return F.when((F.size(changes) > 0) & (F.size(cids) > 0), pair)


def weight_of(importance: Column, table: dict[str, int] | None = None) -> Column:
    """The weight of an importance; 0 for unknown ones."""
    pairs = [F.lit(x) for kv in (table or K.SEVERITY).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), importance), F.lit(0))


def policy_weight(weight: Column, policy: str | Column) -> Column:
    """Weight of a bug under a policy: flat 1, linear w, strong 2^(w-1), weak 2^((w-1)/2)."""
    p = F.lit(policy) if isinstance(policy, str) else policy
    w = weight.cast("double")
    return F.when(p == "flat", F.lit(1.0)).when(p == "linear", w).when(p == "strong_exp", F.pow(F.lit(2.0), w - 1)).when(p == "weak_exp", F.pow(F.lit(2.0), (w - 1) / 2))


def log1(value: Column) -> Column:
    """ln(x + 1)."""
    return F.log1p(value.cast("double"))
