"""Queries of the operators on commits, bugs, reviews and their scores, with SQL counterparts.

Where the data has no blame or prediction tables, the star-schema tables stand
for them: line items are blamed lines (order = fix, supplier = commit, part =
file), order priorities are importances, customers are authors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import parsing as P
from ..langdiff import metrics as lang
from ..ml import evaluate as ev
from ..ml import features as feat
from ..ml import windows as win
from ..operators import authors, bugfix, graph, guilt, joins, ordering, ranges, reviews
from ..runtime import current_rows, table, undeleted
from ..sources import jsonl, tracker

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# what the queries read ------------------------------------------------------
PRIORITY = {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Unknown", "5-LOW": "Low"}
NAMED = ["Critical", "High", "Medium", "Low"]
SEVERITY_SQL = "CASE {0} WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
CC = "cur_c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ingested_at DESC) AS rn_ FROM commits) WHERE rn_ = 1 AND NOT coalesce(tombstone, false))"
CB = "cur_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn_ FROM bugs) WHERE rn_ = 1 AND NOT coalesce(tombstone, false))"
CD = "cur_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _number ORDER BY ingested_at DESC) AS rn_ FROM change_details) WHERE rn_ = 1 AND NOT coalesce(tombstone, false))"
CH = "cur_h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _number ORDER BY ingested_at DESC) AS rn_ FROM changes) WHERE rn_ = 1 AND NOT coalesce(tombstone, false))"
IMP = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unknown' END"


def commits(s: SparkSession, d: str) -> DataFrame:
    return undeleted(current_rows(table(s, d, "commits"), ["cid"]))


def bugs(s: SparkSession, d: str) -> DataFrame:
    return undeleted(current_rows(table(s, d, "bugs"), ["id"]))


def changes(s: SparkSession, d: str) -> DataFrame:
    return undeleted(current_rows(table(s, d, "changes"), ["_number"]))


def details(s: SparkSession, d: str) -> DataFrame:
    return undeleted(current_rows(table(s, d, "change_details"), ["_number"]))


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def severities(s: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("Unknown")).alias("importance"))


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# scores ---------------------------------------------------------------------
@query("SELECT l_orderkey, l_suppkey, round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 6) AS guilt FROM lineitem GROUP BY 1, 2")
def normalized_guilt(s, d):
    return guilt.normalised(lines(s, d), ["l_orderkey"], "l_suppkey").select("l_orderkey", "l_suppkey", r6("guilt"))


@query("SELECT l_orderkey, l_suppkey, round(sum(pow(2.0, 1 - l_linenumber)) / sum(sum(pow(2.0, 1 - l_linenumber))) OVER (PARTITION BY l_orderkey), 6) AS guilt FROM lineitem GROUP BY 1, 2")
def proximity_guilt(s, d):
    return guilt.normalised(lines(s, d), ["l_orderkey"], "l_suppkey", guilt.proximity_weight(F.col("l_linenumber"))).select("l_orderkey", "l_suppkey", r6("guilt"))


@query("SELECT l_orderkey, l_partkey, round(sum(1.0 / l_linenumber) / sum(sum(1.0 / l_linenumber)) OVER (PARTITION BY l_orderkey), 9) AS share FROM lineitem GROUP BY 1, 2")
def guilt_share_by_file(s, d):
    return guilt.by_file(lines(s, d), ["l_orderkey"], "l_partkey", guilt.proximity_weight(F.col("l_linenumber"), exponential=False)).select("l_orderkey", "l_partkey", F.round("share", 9).alias("share"))


_SHARES = f"sh AS (SELECT l_orderkey, l_suppkey, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS g FROM lineitem GROUP BY 1, 2), im AS (SELECT o_orderkey AS l_orderkey, {IMP} AS importance FROM orders), sr AS (SELECT l_suppkey, importance, g FROM sh JOIN im USING (l_orderkey))"
_RAW = ", ".join(f"round(sum(CASE WHEN importance = '{n}' THEN g ELSE 0 END), 6) AS {n}" for n in NAMED)


def _raw(s, d):
    return guilt.raw_by_severity(guilt.normalised(lines(s, d), ["l_orderkey"], "l_suppkey"), severities(s, d), ["l_orderkey"], "l_suppkey", NAMED)


@query(f"WITH {_SHARES} SELECT l_suppkey, round(sum(g), 6) AS guilt, {_RAW} FROM sr GROUP BY 1")
def raw_guilt_by_severity(s, d):
    return _raw(s, d).select("l_suppkey", r6("guilt"), *[r6(n) for n in NAMED])


def _grid_sql() -> str:
    w = {n: K.SEVERITY[n] for n in NAMED}
    cells = []
    for policy in K.POLICIES:
        for level in K.LEVELS:
            b = K.BASE_LEVEL[level]
            f = {"flat": lambda x: "1.0", "linear": lambda x: f"{x}.0", "strong_exp": lambda x: f"pow(2.0, {x - 1})", "weak_exp": lambda x: f"pow(2.0, {x - 1} / 2.0)"}[policy]
            terms = " + ".join(f"sum(CASE WHEN importance = '{n}' THEN g ELSE 0 END) * {f(v - b)}" for n, v in w.items() if v > b)
            cells.append(f"SELECT l_suppkey, '{policy}' AS policy, '{level}' AS level, round({terms}, 5) AS total FROM sr GROUP BY l_suppkey")
    return f"WITH {_SHARES} " + " UNION ALL ".join(cells)


@query(_grid_sql())
def total_guilt_grid(s, d):
    return guilt.total_grid(_raw(s, d), "l_suppkey", {n: K.SEVERITY[n] for n in NAMED}).select("l_suppkey", "policy", "level", F.round("total", 5).alias("total"))


@query(f"WITH {_SHARES} SELECT l_suppkey, round(sum(g * {SEVERITY_SQL.format('importance')}), 6) AS guilt FROM sr WHERE {SEVERITY_SQL.format('importance')} > 0 GROUP BY 1")
def weighted_guilt(s, d):
    return guilt.weighted(guilt.normalised(lines(s, d), ["l_orderkey"], "l_suppkey"), severities(s, d), ["l_orderkey"], "l_suppkey").select("l_suppkey", r6("guilt"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) < 5)")
def small_blame_entries(s, d):
    return guilt.small_entries(lines(s, d), ["l_orderkey"], 5).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def entries_without_blame(s, d):
    return guilt.without_blame(table(s, d, "orders").select("o_orderkey"), lines(s, d).select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


# authors --------------------------------------------------------------------
def _authors(s, d):
    return authors.per_author(table(s, d, "orders"), "o_custkey", "o_totalprice")


_AU = "au AS (SELECT o_custkey, count(*) AS commits, sum(o_totalprice) AS guilt, sum(o_totalprice) / count(*) AS rate FROM orders GROUP BY 1)"


@query(f"WITH {_AU} SELECT o_custkey, commits, round(guilt, 2) AS guilt, round(rate, 6) AS rate FROM au")
def author_totals(s, d):
    return _authors(s, d).select("o_custkey", "commits", F.round("guilt", 2).alias("guilt"), r6("rate"))


@query(f"WITH {_AU} SELECT o_custkey, commits FROM au WHERE commits > 10")
def active_authors(s, d):
    return authors.active(_authors(s, d)).select("o_custkey", "commits")


@query(f"WITH {_AU} SELECT o_custkey, round(rate, 6) AS rate FROM au ORDER BY au.rate DESC, o_custkey LIMIT 10")
def top_authors_by_rate(s, d):
    return authors.top(_authors(s, d), "rate", "o_custkey").select("o_custkey", r6("rate"))


@query(f"WITH {_AU} SELECT o_custkey, commits FROM au ORDER BY commits, o_custkey LIMIT 100")
def bottom_authors_by_commits(s, d):
    return authors.top(_authors(s, d), "commits", "o_custkey", 100, descending=False).select("o_custkey", "commits")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN lo AND hi")
def outlier_trim(s, d):
    return authors.trim(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(f"WITH {_AU}, w AS (SELECT o_custkey, row_number() OVER (ORDER BY rate DESC, o_custkey) - 1 AS position, sum(guilt) OVER (ORDER BY rate DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER () AS n, sum(guilt) OVER () AS al FROM au) SELECT o_custkey, position, round(total, 2) AS total, round(100.0 * position / n, 6) AS x, round(total / al, 6) AS y FROM w")
def cumulative_guilt(s, d):
    return authors.cumulative(_authors(s, d), "guilt", "rate", "o_custkey").select("o_custkey", "position", F.round("total", 2).alias("total"), r6("x"), r6("y"))


@query(f"WITH {_AU}, h AS (SELECT cast(floor(commits / 5.0) AS BIGINT) AS bin, count(*) AS n FROM au GROUP BY 1) SELECT bin, n, sum(n) OVER (ORDER BY bin) AS running FROM h")
def commits_histogram(s, d):
    return authors.histogram(_authors(s, d), "commits", 5.0)


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3 FROM customer GROUP BY 1")
def quartiles_by_segment(s, d):
    return authors.quartiles(table(s, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", r6("q1"), r6("median"), r6("q3"))


@query(f"WITH {CC}, a AS (SELECT cid, committed_date, trim(regexp_extract(committer, '<([^<>]*)>\">', 1)) AS email FROM cur_c WHERE committer IS NOT NULL), b AS (SELECT *, split_part(email, '@', 1) AS loc, split_part(email, '@', -1) AS dom FROM a WHERE email LIKE '%@%' AND committed_date IS NOT NULL), f AS (SELECT loc, row_number() OVER (ORDER BY min(committed_date), loc) AS n FROM b GROUP BY 1) SELECT cid, 'anon_' || n || '@' || dom AS anonymous FROM b JOIN f USING (loc)")
def anonymous_authors(s, d):
    email = F.regexp_extract("committer", '<([^<>]*)>">', 1)
    rows = commits(s, d).filter("committer is not null and committed_date is not null").select("cid", "committed_date", F.trim(email).alias("email")).filter("email like '%@%'")
    return authors.anonymous(rows, F.substring_index("email", "@", 1), F.substring_index("email", "@", -1), "committed_date").select("cid", "anonymous")


# orders ---------------------------------------------------------------------
_DATED = f"WITH {CC}, o AS (SELECT cid, author, files, committed_date, row_number() OVER (ORDER BY committed_date, cid) AS \"order\" FROM cur_c WHERE committed_date IS NOT NULL)"


def _ordered(s, d):
    return ordering.dense_order(commits(s, d).filter("committed_date is not null").select("cid", "author", "files", "committed_date", "on_master_branch"), ["committed_date", "cid"], slices=16)


@query(_DATED + ' SELECT cid, "order" FROM o')
def commit_order(s, d):
    return _ordered(s, d).select("cid", "order")


@query(_DATED + ' SELECT cid, row_number() OVER (PARTITION BY author ORDER BY "order") AS author_order FROM o')
def author_order(s, d):
    return ordering.order_within(_ordered(s, d), ["author"], ["order"], "author_order", 16).select("cid", "author_order")


@query(_DATED + ', f AS (SELECT DISTINCT cid, "order", author, unnest(files) AS file FROM o) SELECT cid, file, row_number() OVER (PARTITION BY file ORDER BY "order") AS file_order, row_number() OVER (PARTITION BY file, author ORDER BY "order") AS file_order_for_author FROM f')
def file_orders(s, d):
    f = _ordered(s, d).select("cid", "order", "author", F.explode("files").alias("file")).distinct()
    f = ordering.order_within(f, ["file"], ["order"], "file_order", 16)
    return ordering.order_within(f, ["file", "author"], ["order"], "file_order_for_author", 16).select("cid", "file", "file_order", "file_order_for_author")


@query(_DATED + ' SELECT min("order") AS least, max("order") AS greatest FROM o WHERE committed_date > 1400000000')
def order_range(s, d):
    return ordering.order_range(_ordered(s, d), reachable=None, cutoff=1_400_000_000, date="committed_date")


@query(_DATED + ' SELECT cid FROM o WHERE "order" >= 1 + floor((SELECT max("order") FROM o) * 0.25) AND "order" < 1 + floor((SELECT max("order") FROM o) * 0.25) + floor((SELECT max("order") FROM o) * 0.5)')
def order_window(s, d):
    return ordering.order_window(_ordered(s, d), 0.25, 0.5).select("cid")


@query(f"WITH {CC} SELECT CASE WHEN max(CASE WHEN change_id IS NULL THEN committed_date END) IS NULL OR min(CASE WHEN change_id IS NOT NULL THEN committed_date END) > max(CASE WHEN change_id IS NULL THEN committed_date END) THEN min(CASE WHEN change_id IS NOT NULL THEN committed_date END) - 1 ELSE max(CASE WHEN change_id IS NULL THEN committed_date END) END AS cutoff FROM cur_c WHERE on_master_branch")
def legacy_cutoff(s, d):
    return bugfix.legacy_cutoff(commits(s, d).filter("on_master_branch"), F.col("change_id").isNotNull(), F.col("committed_date"))


@query(_DATED + ', b AS (SELECT min("order") AS lo, max("order") AS hi FROM o WHERE committed_date > 1350000000), e AS (SELECT min(committed_date) FILTER ("order" = lo) AS first, min(committed_date) FILTER ("order" = hi) AS last FROM o, b) SELECT count(*) AS fixes FROM o JOIN cur_c c USING (cid), e WHERE c.on_master_branch AND o.committed_date >= greatest(coalesce(first, 1350000000), 1350000000) AND (last IS NULL OR o.committed_date <= last)')
def bug_fix_count(s, d):
    rows = _ordered(s, d).withColumn("tagged_bug_fix", F.coalesce("on_master_branch", F.lit(False))).withColumnRenamed("committed_date", "date")
    ends = ordering.order_range(rows, reachable=None, cutoff=1_350_000_000).first()
    return bugfix.count_fixes(rows, ends["least"], ends["greatest"], 1_350_000_000)


# parsing --------------------------------------------------------------------
@query(f"WITH {CC} SELECT cid, trim(regexp_extract(committer, '(?s)\"(.*)<[^<>]*>', 1)) AS name, trim(regexp_extract(committer, '(?s)\".*<([^<>]*)>', 1)) AS email FROM cur_c WHERE regexp_matches(committer, '(?s)\".*<[^<>]*>')")
def parse_actor(s, d):
    c = F.col("committer")
    return commits(s, d).select("cid", P.actor_name(c).alias("name"), P.actor_email(c).alias("email")).filter("name is not null")


@query(f"WITH {CC}, a AS (SELECT cid, regexp_replace(coalesce(nullif(regexp_extract(author, '<(\\S+@\\S+)>', 1), ''), nullif(regexp_extract(author, '\"(\\S+@\\S+)\\s', 1), ''), nullif(regexp_extract(author, '\"(\\S+)\\s', 1), '')), '>\"$', '') AS address FROM cur_c) SELECT cid, address, split_part(address, '@', -1) AS org FROM a")
def parse_author_org(s, d):
    a = F.col("author")
    return commits(s, d).select("cid", P.author_address(a).alias("address"), P.author_org(a).alias("org"))


@query(f"WITH {CC} SELECT cid, lower(author) = lower(committer) OR coalesce(lower(trim(regexp_extract(author, '(?s)\"(.*)<[^<>]*>', 1))) = lower(trim(regexp_extract(committer, '(?s)\"(.*)<[^<>]*>', 1))), false) OR coalesce(lower(trim(regexp_extract(author, '(?s)\".*<([^<>]*)>', 1))) = lower(trim(regexp_extract(committer, '(?s)\".*<([^<>]*)>', 1))), false) AS same FROM cur_c WHERE regexp_matches(committer, '(?s)\".*<[^<>]*>') AND regexp_matches(author, '(?s)\".*<[^<>]*>')")
def same_actor(s, d):
    form = r'(?s)".*<[^<>]*>'
    return commits(s, d).filter(F.col("author").rlike(form) & F.col("committer").rlike(form)).select("cid", P.same_actor(F.col("author"), F.col("committer")).alias("same"))


@query(f"WITH {CC}, l AS (SELECT cid, unnest(string_split(msg, chr(10))) AS line, generate_subscripts(string_split(msg, chr(10)), 1) AS i FROM cur_c), m AS (SELECT cid, i, regexp_extract(line, '[Cc]hange-[Ii]d:\\s*(I[a-f0-9]{{40}})', 1) AS v FROM l WHERE lower(line) LIKE 'change%') SELECT cid, arg_max(v, i) AS change_id FROM m WHERE v <> '' GROUP BY 1")
def parse_change_ids(s, d):
    return commits(s, d).select("cid", P.change_id(F.col("msg")).alias("change_id")).filter("change_id is not null")


_BUG_LINE = "contains(l, 'bug') AND (" + " OR ".join(f"starts_with(l, '{x}')" for x in K.BUG_ACCEPT_START) + " OR (NOT (" + " OR ".join(f"contains(l, '{x}')" for x in K.BUG_REJECT) + ") AND (" + " OR ".join(f"contains(l, '{x}')" for x in K.BUG_ACCEPT) + ")))"


@query(f"WITH {CC}, l AS (SELECT cid, unnest(string_split(lower(msg), chr(10))) AS l FROM cur_c) SELECT DISTINCT cid, unnest(regexp_extract_all(l, '{K.BUG_NUMBER}', 1)) AS bug FROM l WHERE {_BUG_LINE}")
def parse_bug_ids(s, d):
    return commits(s, d).select("cid", F.explode(P.bug_ids(F.col("msg"))).alias("bug"))


@query(f"WITH {CC}, m AS (SELECT cid, 'Implements blueprint: ' || split_part(lower(project), '/', -1) || '.' AS t FROM cur_c) SELECT cid, regexp_replace(regexp_extract(lower(t), 'blueprint:?\\s*(\\S+)$', 1), '\\.$', '') AS blueprint FROM m WHERE t IS NOT NULL")
def parse_blueprint(s, d):
    text = F.concat(F.lit("Implements blueprint: "), F.substring_index(F.lower("project"), "/", -1), F.lit("."))
    return commits(s, d).select("cid", P.blueprint(text).alias("blueprint")).filter("blueprint is not null")


@query(f"WITH {CC}, p AS (SELECT cid, regexp_extract(msg, '\\(cherry picked from commit ([a-f0-9]{{40}})', 1) AS f FROM cur_c WHERE on_master_branch) SELECT DISTINCT cid, f AS picked_from FROM p WHERE f IN (SELECT cid FROM cur_c)")
def cherry_links(s, d):
    return joins.cherry_picks(commits(s, d))


@query(f"WITH {CC}, f AS (SELECT DISTINCT cid, unnest(unfiltered_files) AS path FROM cur_c) SELECT cid, path, NOT starts_with(path, 'tools/') AND (" + " OR ".join(f"ends_with(path, '{x}')" for x in K.INCLUDE_SUFFIXES) + ") AS kept FROM f")
def file_filter(s, d):
    return commits(s, d).select("cid", F.explode("unfiltered_files").alias("path")).distinct().withColumn("kept", P.analysed_file(F.col("path")))


@query(f"WITH {CC} SELECT project, sum(cast(starts_with(lower(msg), 'merge') AS INT)) AS merges, sum(cast(contains(lower(msg), 'bug') AS INT)) AS bug, sum(cast(contains(lower(msg), 'fix') AS INT)) AS fix, sum(cast(contains(lower(msg), '#') AS INT)) AS number, count(*) AS commits FROM cur_c GROUP BY 1")
def message_classes(s, d):
    c = commits(s, d).withColumn("k", P.message_class(F.col("msg")))
    return c.groupBy("project").agg(F.sum(F.lower("msg").startswith("merge").cast("int")).alias("merges"), *[F.sum(F.col(f"k.{n}").cast("int")).alias(n) for n in ("bug", "fix", "number")], F.count(F.lit(1)).alias("commits"))


_LINK_URL = "Committed: https://git.heliograph.example/"


@query(f"WITH {CB}, m AS (SELECT id, unnest(messages).content AS t, generate_subscripts(messages, 1) - 1 AS pos FROM cur_b), l AS (SELECT id, pos, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m), v AS (SELECT id, pos, arg_max(trim(split_part(x, ':', -1)), i) FILTER (contains(x, 'Change-Id: I')) AS change_id, arg_max(regexp_extract(x, '([^/=]*)$', 1), i) FILTER (NOT contains(x, 'Change-Id: I') AND contains(x, '{_LINK_URL}')) AS cid FROM l GROUP BY 1, 2) SELECT id, pos, change_id, cid FROM v WHERE change_id IS NOT NULL AND cid IS NOT NULL")
def tracker_message_links(s, d):
    m = bugs(s, d).select("id", F.posexplode("messages").alias("pos", "m"))
    return m.select("id", "pos", P.tracker_links(F.col("m.content"), [_LINK_URL]).alias("x")).filter("x is not null").select("id", "pos", "x.change_id", "x.cid")


# bugs -----------------------------------------------------------------------
_GOOD = "status IN ('Fix Committed', 'Fix Released') AND importance IN ('Critical', 'High', 'Medium')"


@query(f"WITH {CB} SELECT id, coalesce(status IN ('Fix Committed', 'Fix Released') AND (importance IN ('Critical', 'High', 'Medium') OR coalesce(heat >= 20, false)), false) AS counts FROM cur_b")
def bug_filter(s, d):
    return bugs(s, d).select("id", bugfix.qualified(F.col("importance"), F.col("status"), F.col("heat"), "med+", "fixed", 20).alias("counts"))


_LINKS = "lk AS (SELECT DISTINCT cid, bug_id FROM (SELECT cid, unnest(bugs) AS bug_id FROM cur_c) WHERE bug_id IN (SELECT id FROM cur_b) UNION SELECT c.cid, id FROM (SELECT id, unnest(commits) AS c FROM cur_b) WHERE c.cid IN (SELECT cid FROM cur_c))"


@query(f"WITH {CC}, {CB}, {_LINKS} SELECT cid, bug_id FROM lk")
def bug_join_two_paths(s, d):
    return joins.commit_bug_links(commits(s, d), bugs(s, d)).select("cid", "bug_id")


@query(f"WITH {CC}, {CB}, {_LINKS} SELECT DISTINCT cid FROM lk JOIN cur_b ON id = bug_id WHERE {_GOOD}")
def bug_fix_commits(s, d):
    b = bugs(s, d)
    return bugfix.bug_fix_commits(joins.commit_bug_links(commits(s, d), b), b, level="med+")


@query(f"WITH {CC}, {CB}, {_LINKS} SELECT cid, count(*) AS bugs, max(heat) AS heat, max({SEVERITY_SQL.format('importance')}) AS severity, coalesce(max(CASE importance WHEN 'Critical' THEN 6 WHEN 'High' THEN 5 WHEN 'Medium' THEN 4 WHEN 'Low' THEN 3 WHEN 'Wishlist' THEN 2 WHEN 'Unknown' THEN 1 ELSE 0 END), 0) AS precedence, sum(coalesce(len(messages), 0)) AS messages, bool_or(coalesce(security_related, false)) AS security, sum(coalesce(len(cves), 0)) AS cves FROM lk JOIN cur_b ON id = bug_id GROUP BY 1")
def bug_features(s, d):
    b = joins.join_with_bugs(commits(s, d).select("cid", "bugs"), bugs(s, d)).filter("bug_details is not null").select("cid", F.explode("bug_details").alias("x")).select("cid", "x.*")
    return b.groupBy("cid").agg(F.count(F.lit(1)).alias("bugs"), F.max("heat").alias("heat"), F.max(P.weight_of(F.col("importance"))).alias("severity"), F.max(P.weight_of(F.col("importance"), K.PRECEDENCE)).alias("precedence"), F.sum("n_messages").alias("messages"), F.bool_or(F.coalesce("security_related", F.lit(False))).alias("security"), F.sum("n_cves").alias("cves"))


@query(f"WITH {CB} SELECT id, coalesce(contains(lower(description), 'scheduler'), false) OR coalesce(list_bool_or(list_transform(messages, lambda m: coalesce(contains(lower(m.content), 'scheduler'), false))), false) AS mentions FROM cur_b")
def bug_mentions(s, d):
    return bugs(s, d).select("id", bugfix.mentions(F.col("description"), F.col("messages"), "scheduler").alias("mentions"))


@query(f"WITH {CC}, {CB} SELECT DISTINCT b AS id FROM (SELECT unnest(bugs) AS b FROM cur_c) WHERE b IS NOT NULL AND b NOT IN (SELECT id FROM cur_b)")
def missing_bugs(s, d):
    return joins.missing_keys(commits(s, d).select(F.explode("bugs").alias("id")), bugs(s, d), "id")


@query(f"WITH {CB} SELECT DISTINCT id FROM cur_b WHERE status IN ('Fix Committed', 'Fix Released', 'Confirmed', 'In Progress')")
def bugs_worked_on(s, d):
    return tracker.worked_on(bugs(s, d))


@query("SELECT id, arg_max(status, ingested_at) AS status FROM bugs WHERE status IS NOT NULL GROUP BY 1")
def last_bug_status(s, d):
    return joins.last_assignment(table(s, d, "bugs").filter("status is not null"), "id", "ingested_at", "status")


# reviews --------------------------------------------------------------------
_PICK = "row_number() OVER (PARTITION BY change_id ORDER BY ingested_at DESC, _number DESC) AS rn2"


@query(f"WITH {CC}, {CD}, {CH}, h AS (SELECT change_id, _number AS number FROM (SELECT *, {_PICK} FROM cur_h WHERE branch = 'master' AND status = 'MERGED' AND change_id IS NOT NULL) WHERE rn2 = 1), dd AS (SELECT change_id, owner FROM (SELECT *, {_PICK} FROM cur_d WHERE branch = 'master' AND status = 'MERGED' AND change_id IS NOT NULL) WHERE rn2 = 1) SELECT cid, number, owner.name AS owner FROM cur_c c LEFT JOIN (h JOIN dd USING (change_id)) USING (change_id)")
def review_join_latest(s, d):
    return joins.join_with_reviews(commits(s, d).select("cid", "change_id"), changes(s, d), details(s, d)).select("cid", "number", F.col("owner.name").alias("owner"))


@query(f"WITH {CD}, v AS (SELECT _number, unnest(labels['Code-Review'].all) AS x FROM cur_d), a AS (SELECT _number, count(*) AS cast_votes FROM (SELECT _number, x FROM v) WHERE x IS NOT NULL AND coalesce(x.value, 0) <> 0 GROUP BY 1), t AS (SELECT _number, sum(coalesce(x.value, 0)) AS votes FROM v WHERE x IS NOT NULL GROUP BY 1) SELECT _number, coalesce(votes, 0) AS votes, coalesce(cast_votes, 0) AS cast_votes, list_max(list_transform(list_filter(messages, lambda m: m IS NOT NULL), lambda m: m._revision_number)) AS revision, labels['Code-Review'].approved.name AS approved FROM cur_d LEFT JOIN a USING (_number) LEFT JOIN t USING (_number)")
def vote_summary(s, d):
    code = F.try_element_at("labels", F.lit("Code-Review"))
    return details(s, d).select("_number", reviews.vote_sum(code).alias("votes"), F.greatest(F.size(reviews.cast_votes(code)), F.lit(0)).alias("cast_votes"), reviews.max_revision(F.col("messages")).alias("revision"), code["approved"]["name"].alias("approved"))


@query(f"WITH {CD}, l AS (SELECT _number, unnest(map_entries(labels)) AS e FROM cur_d) SELECT _number, e.key AS label FROM l WHERE e.key IN ('Workflow', 'Verified', 'Code-Review') AND e.value IS NOT NULL")
def kept_labels(s, d):
    return details(s, d).select("_number", F.explode(F.map_keys(reviews.kept_labels(F.col("labels")))).alias("label"))


@query(f"WITH {CD}, m AS (SELECT _number, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM cur_d), r AS (SELECT _number, arg_max(m._revision_number, i) AS last FROM m WHERE m IS NOT NULL AND m._revision_number IS NOT NULL GROUP BY 1) SELECT m._number, count(*) AS messages FROM m LEFT JOIN r USING (_number) WHERE m.m IS NOT NULL AND (m.m._revision_number IS NULL OR m.m._revision_number = r.last) GROUP BY 1")
def last_revision_messages(s, d):
    return details(s, d).select("_number", F.size(reviews.last_revision_messages(F.col("messages"))).alias("messages")).filter("messages > 0")


@query(f"WITH {CD} SELECT _number, labels IS NOT NULL OR messages IS NOT NULL AS has_data, list_max(list_transform(list_filter(messages, lambda m: m IS NOT NULL), lambda m: m._revision_number)) AS revision, labels['Code-Review'].approved.name AS approved_code, labels['Workflow'].approved.name AS approved_workflow, coalesce(list_sum(list_transform(list_filter(labels['Code-Review'].all, lambda v: v IS NOT NULL), lambda v: coalesce(v.value, 0))), 0) AS votes FROM cur_d")
def review_features(s, d):
    return details(s, d).select("_number", reviews.review_features(F.col("labels"), F.col("messages")).alias("f")).select("_number", "f.*")


@query(f"WITH {CC}, p AS (SELECT cid, regexp_extract(msg, '\\(cherry picked from commit ([a-f0-9]{{40}})', 1) AS f FROM cur_c WHERE on_master_branch) SELECT f AS cid, array_to_string(list_sort(list(DISTINCT cid)), ' ') AS picked_to FROM p WHERE f IN (SELECT cid FROM cur_c) GROUP BY 1")
def cherry_reverse(s, d):
    return joins.picked_to(joins.cherry_picks(commits(s, d))).select("cid", F.array_join("picked_to", " ").alias("picked_to"))


@query(f"WITH {CH}, {CD} SELECT DISTINCT change_id FROM cur_h WHERE change_id IS NOT NULL AND change_id NOT IN (SELECT change_id FROM cur_d WHERE change_id IS NOT NULL)")
def details_to_fetch(s, d):
    return joins.new_rows(changes(s, d).select("change_id").filter("change_id is not null").distinct(), details(s, d).filter("change_id is not null"), "change_id")


@query(f"WITH {CH} SELECT _number, _sortkey FROM cur_h WHERE _sortkey < '02' ORDER BY _sortkey DESC, _number LIMIT 100")
def review_page(s, d):
    return tracker.page_after(changes(s, d).select("_number", "_sortkey"), "02", 100)


@query(f"WITH {CH}, {CD} SELECT _number, change_id FROM cur_d UNION ALL SELECT _number, change_id FROM cur_h WHERE _number NOT IN (SELECT _number FROM cur_d)")
def union_prior_wins(s, d):
    return joins.merge_prior_wins(details(s, d).select("_number", "change_id"), changes(s, d).select("_number", "change_id"), "_number")


@query(f"WITH {CC} SELECT count(*) AS total, count(*) FILTER (len(bugs) > 0) AS with_bugs, count(*) FILTER (change_id IS NOT NULL) AS with_change, count(*) FILTER (len(bugs) > 0 AND change_id IS NOT NULL) AS with_both FROM cur_c")
def commit_counts(s, d):
    return tracker.counts(commits(s, d))


@query(f"WITH {CC} SELECT project, count(*) AS n, count(DISTINCT author) AS authors FROM cur_c GROUP BY 1")
def rows_per_project(s, d):
    return commits(s, d).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("authors"))


@query(f"WITH {CC}, f AS (SELECT DISTINCT unnest(files) AS file FROM cur_c) SELECT file FROM f")
def distinct_files(s, d):
    return commits(s, d).select(F.explode("files").alias("file")).distinct()


@query(f"WITH {CC} SELECT cid FROM cur_c WHERE contains(committer, 'Gatekeeper') OR contains(committer, 'review.')")
def special_committers(s, d):
    return commits(s, d).filter(P.contains_any(F.col("committer"), ["Gatekeeper", "review."])).select("cid")




@query(f"WITH {CC} SELECT cid, NOT (coalesce(on_master_branch, false) AND coalesce(committed_date, 0) > 1400000000 AND coalesce(len(files), 0) = 0) AS reachable FROM cur_c")
def prune_empty_commits(s, d):
    c = commits(s, d).select("cid", F.coalesce("on_master_branch", F.lit(False)).alias("on_master_branch"), F.lit(True).alias("reachable"), F.coalesce("committed_date", F.lit(0)).alias("date"), "files")
    return bugfix.prune_empty(c, 1_400_000_000).select("cid", "reachable")


# graph ----------------------------------------------------------------------
_FP = f"{CC}, fp AS (SELECT cid, parents[1] AS up, coalesce(on_master_branch, false) AS main FROM cur_c)"


@query(f"WITH {CC} SELECT p AS parent, cid AS child, pos FROM (SELECT cid, unnest(parents) AS p, generate_subscripts(parents, 1) - 1 AS pos FROM cur_c WHERE on_master_branch) WHERE p IS NOT NULL AND trim(p) <> ''")
def children(s, d):
    return joins.children(commits(s, d)).select("parent", "child", "pos")


@query(f"WITH RECURSIVE {_FP}, w AS (SELECT cid AS node, cid AS here, 0 AS distance FROM fp UNION SELECT w.node, f.up, w.distance + 1 FROM w JOIN fp f ON f.cid = w.here WHERE NOT f.main AND f.up IN (SELECT cid FROM fp) AND w.distance < (SELECT count(*) FROM fp)) SELECT node, here AS stop, distance FROM w JOIN fp f ON f.cid = w.here WHERE f.main")
def first_mainline_ancestor(s, d):
    c = commits(s, d)
    return graph.walk_to(graph.first_parents(c), c.filter("coalesce(on_master_branch, false)").select(F.col("cid").alias("node"))).filter("stop is not null").select("node", "stop", "distance")


def _heads(s, d):
    return commits(s, d).filter("on_master_branch").groupBy("project").agg(F.max_by("cid", F.struct("committed_date", "cid")).alias("node")).select("node")


_HEADS = f"{_FP}, hd AS (SELECT cid FROM (SELECT cid, row_number() OVER (PARTITION BY project ORDER BY committed_date DESC NULLS LAST, cid DESC) AS k FROM cur_c WHERE on_master_branch) WHERE k = 1), ml AS (SELECT cid AS node, 0 AS position FROM hd UNION SELECT f.up, m.position + 1 FROM ml m JOIN fp f ON f.cid = m.node WHERE f.up IN (SELECT cid FROM fp) AND m.position < (SELECT count(*) FROM fp)), mm AS (SELECT node, min(position) AS position FROM ml GROUP BY 1)"


def _mainline(s, d):
    c = commits(s, d)
    known = c.select(F.col("cid").alias("parent"))
    links = graph.first_parents(c).join(known, "parent", "left_semi").select("node", "parent")
    return graph.mainline(links, _heads(s, d))


@query(f"WITH RECURSIVE {_HEADS} SELECT node, position FROM mm")
def mainline_walk(s, d):
    return _mainline(s, d)


@query(f"WITH RECURSIVE {_HEADS} SELECT cid, on_master_branch AND coalesce(len(parents), 0) >= 2 AND cid IN (SELECT node FROM mm) AS merge FROM cur_c WHERE on_master_branch IS NOT NULL")
def merge_commits(s, d):
    line = _mainline(s, d).select(F.col("node").alias("cid"), F.lit(True).alias("on_mainline"))
    c = commits(s, d).filter("on_master_branch is not null").join(line, "cid", "left").fillna(False, ["on_mainline"])
    return c.select("cid", bugfix.is_merge(c).alias("merge"))


@query(f"WITH RECURSIVE {_HEADS} SELECT node, position FROM mm WHERE position % 25 = 0 OR position = (SELECT max(position) FROM mm) - 1")
def mainline_samples(s, d):
    return graph.sample_mainline(_mainline(s, d), 25)


_EDGES = "ed AS (SELECT cid AS child, unnest(parents) AS parent FROM cur_c), off AS (SELECT child, parent FROM ed WHERE parent NOT IN (SELECT cid FROM cur_c WHERE on_master_branch) AND parent IS NOT NULL)"


def _closure(s, d):
    c = commits(s, d)
    merges = c.filter("on_master_branch and size(parents) >= 2").select(F.col("cid").alias("merge"), F.try_element_at("parents", F.lit(2)).alias("node")).filter("node is not null")
    edges = c.select(F.col("cid").alias("child"), F.explode("parents").alias("parent")).filter("parent is not null")
    return graph.branch_closure(merges, edges, c.filter("on_master_branch").select(F.col("cid").alias("node")))


_CLOSURE = f"{CC}, {_EDGES}, bc AS (SELECT cid AS merge, parents[2] AS node, 1 AS depth FROM cur_c WHERE on_master_branch AND len(parents) >= 2 AND parents[2] IS NOT NULL AND parents[2] NOT IN (SELECT cid FROM cur_c WHERE on_master_branch) UNION SELECT b.merge, o.parent, b.depth + 1 FROM bc b JOIN off o ON o.child = b.node WHERE b.depth < (SELECT count(*) FROM cur_c)), bb AS (SELECT merge, node, max(depth) AS depth FROM bc GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_CLOSURE} SELECT merge, node, depth FROM bb")
def branch_closure(s, d):
    return _closure(s, d)


@query(f"WITH RECURSIVE {_CLOSURE} SELECT merge, count(DISTINCT author) AS authors, count(DISTINCT committer) AS committers, count(DISTINCT change_id) AS changes, count(*) FILTER (change_id IS NOT NULL) AS commits_with_changes, max(len(parents)) AS most_parents, max(depth) AS depth FROM bb JOIN cur_c ON cid = node GROUP BY 1")
def branch_summary(s, d):
    return graph.closure_summary(_closure(s, d), commits(s, d))


@query("SELECT DISTINCT l_suppkey AS cid FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def reachable_commits(s, d):
    samples = table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"))
    return graph.reachable(samples, lines(s, d).select(F.col("l_orderkey").alias("at"), F.col("l_suppkey").alias("cid")))


_ACTORS = f"{CC}, ac AS (SELECT actor, max(coalesce(committed_date, 0)) AS t FROM (SELECT author AS actor, committed_date FROM cur_c UNION ALL SELECT committer, committed_date FROM cur_c) WHERE regexp_matches(actor, '(?s)\".*<[^<>]*>') GROUP BY 1), ne AS (SELECT actor, t, lower(trim(regexp_extract(actor, '(?s)\"(.*)<[^<>]*>', 1))) AS n, lower(trim(regexp_extract(actor, '(?s)\".*<([^<>]*)>', 1))) AS e FROM ac)"


@query(f"WITH RECURSIVE {_ACTORS}, k AS (SELECT actor, 'n:' || n AS k FROM ne WHERE n <> '' UNION SELECT actor, 'e:' || e FROM ne WHERE e <> ''), r AS (SELECT DISTINCT actor AS a, actor AS b FROM ne UNION SELECT r.a, k2.actor FROM r JOIN k k1 ON k1.actor = r.b JOIN k k2 ON k2.k = k1.k), g AS (SELECT a, min(b) AS c FROM r GROUP BY 1), st AS (SELECT c, arg_max(actor, (t, actor)) AS standard_actor FROM g JOIN ne ON a = actor GROUP BY 1) SELECT a AS actor, standard_actor FROM g JOIN st USING (c)")
def actor_aliases(s, d):
    c = commits(s, d)
    a = c.select(F.col("author").alias("actor"), F.coalesce("committed_date", F.lit(0)).alias("at")).unionAll(c.select("committer", F.coalesce("committed_date", F.lit(0)))).filter(F.col("actor").rlike(r'(?s)".*<[^<>]*>'))
    return graph.actor_aliases(a.select("actor", P.actor_name(F.col("actor")).alias("name"), P.actor_email(F.col("actor")).alias("email"), "at"))


# ranges ---------------------------------------------------------------------
@query("WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM u) SELECT l_orderkey, min(l_linenumber) AS \"start\", max(l_linenumber) AS \"end\" FROM i GROUP BY l_orderkey, g")
def line_runs(s, d):
    return ranges.line_runs(lines(s, d), ["l_orderkey"], "l_linenumber")


_RANGES = "rg AS (SELECT l_suppkey, l_partkey AS a, l_partkey + cast(l_quantity AS BIGINT) AS b FROM lineitem)"


def _ranges(s, d):
    return lines(s, d).select("l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"))


@query(f"WITH {_RANGES}, p AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg), q AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT l_suppkey, min(a) AS \"start\", max(b) AS \"end\" FROM q GROUP BY l_suppkey, g")
def merged_ranges(s, d):
    return ranges.merge_ranges(_ranges(s, d), ["l_suppkey"])


@query(f"WITH {_RANGES} SELECT l_suppkey, count(DISTINCT x) AS lines FROM (SELECT l_suppkey, unnest(generate_series(a, b)) AS x FROM rg) GROUP BY 1")
def range_line_counts(s, d):
    return ranges.range_lines(_ranges(s, d), ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))


@query("WITH k AS (SELECT DISTINCT p_partkey, p_size FROM part), w AS (SELECT p_partkey, p_size, unnest(generate_series(p_size, p_size + 9)) AS lineno FROM k) SELECT p_partkey, lineno, abs(lineno - (p_size + 3)) + 1 AS proximity FROM w WHERE abs(lineno - (p_size + 3)) < 4")
def diff_proximity(s, d):
    head = F.concat(F.lit("@@ -"), F.col("p_size"), F.lit(",10 +"), F.col("p_size"), F.lit(",9 @@\n a\n b\n c\n-gone\n d\n e\n f\n g\n h\n i"))
    diffs = table(s, d, "part").select("p_partkey", "p_size", F.concat(F.lit("--- a/x\n+++ b/x\n"), head).alias("diff_text"))
    keys = ["p_partkey", "p_size"]
    return ranges.proximity(ranges.diff_lines(diffs, keys), keys).drop("p_size")


@query(f"WITH {CC} SELECT cid, len(string_split(msg, chr(10))) AS loc_add, 2 AS loc_remove FROM cur_c WHERE msg IS NOT NULL")
def lines_changed(s, d):
    text = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,2 +1,9 @@\n-a\n-b\n+"), F.array_join(F.split("msg", "\n"), "\n+"))
    loc = ranges.lines_of_code(text)
    return commits(s, d).filter("msg is not null").select("cid", loc["add"].alias("loc_add"), loc["remove"].alias("loc_remove"))


# sparse counts, JSON, sets --------------------------------------------------
@query("SELECT l_partkey, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) - coalesce(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 0) AS delta FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def sparse_delta(s, d):
    n = lines(s, d).groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return lang.stats_delta(n.filter("l_returnflag = 'A'"), n.filter("l_returnflag = 'R'"), ["l_partkey"])


@query("SELECT event_type, count(*) AS n, sum(cast(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1")
def json_props(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


@query("SELECT rec_no, change_id, _number FROM (SELECT rec_no, json_extract_string(line, '$.change_id') AS change_id, cast(json_extract_string(line, '$._number') AS INT) AS _number, coalesce(cast(json_extract(line, '$.json_tombstone') AS BOOLEAN), false) AS dead FROM raw_lines WHERE json_valid(line)) WHERE NOT dead AND change_id IS NOT NULL")
def json_lines(s, d):
    raw = table(s, d, "raw_lines").select("rec_no", F.from_json("line", "change_id string, _number int, json_tombstone boolean, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return raw.filter("r._corrupt_record is null and not coalesce(r.json_tombstone, false) and r.change_id is not null").select("rec_no", "r.change_id", "r._number")


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def intersect_ids(s, d):
    a = lines(s, d)
    return a.filter("l_returnflag = 'A'").select("l_suppkey").intersect(a.filter("l_returnflag = 'N'").select("l_suppkey"))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT ps FROM (SELECT l_suppkey AS ps FROM lineitem WHERE l_returnflag = 'R')")
def union_ids(s, d):
    a = lines(s, d)
    return a.filter("l_returnflag = 'A'").select("l_suppkey").union(a.filter("l_returnflag = 'R'").select("l_suppkey")).distinct()


# evaluation -----------------------------------------------------------------
_PRED = "pr AS (SELECT o_orderkey AS row_id, o_orderpriority AS clf, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, (o_orderkey * 7919 % 1000) / 1000.0 AS p1 FROM orders)"


def _predictions(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("clf"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("p1"))


_RATES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


def _cells(hit: str) -> str:
    return f"count(*) FILTER ({hit} AND y = 1) AS tp, count(*) FILTER ({hit} AND y = 0) AS fp, count(*) FILTER (NOT ({hit}) AND y = 1) AS fn, count(*) FILTER (NOT ({hit}) AND y = 0) AS tn"


@query(f"WITH {_PRED}, c AS (SELECT clf, {_cells('p1 > 0.5')} FROM pr GROUP BY 1) SELECT clf, tp, fp, fn, tn, {_RATES} FROM c")
def confusion(s, d):
    return ev.confusion(_predictions(s, d), ["clf"], F.col("p1") > 0.5, F.col("y") == 1).select("clf", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


_NET = f"{_PRED}, pn AS (SELECT clf, y, 2 * p1 - 1 AS p_net FROM pr), th AS (SELECT i * 0.025 AS threshold FROM range(-5, 41) t(i)), sw AS (SELECT clf, threshold, {_cells('p_net > threshold')} FROM pn, th GROUP BY 1, 2)"


def _sweep(s, d):
    return ev.sweep(_predictions(s, d).withColumn("p_net", 2 * F.col("p1") - 1), ["clf"], "p_net", F.col("y") == 1, -5, 40)


@query(f"WITH {_NET} SELECT clf, round(threshold, 3) AS threshold, tp, fp, fn, {_RATES} FROM sw".replace("i * 0.025", "cast(i AS DOUBLE) * cast(0.025 AS DOUBLE)").replace("/ 1000.0", "/ cast(1000 AS DOUBLE)"))
def threshold_sweep(s, d):
    return _sweep(s, d).select("clf", F.round("threshold", 3).alias("threshold"), "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(f"WITH {_PRED} SELECT clf, round(-avg(y * ln(greatest(least(p1, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p1, 1 - 1e-15), 1e-15))), 6) AS log_loss, round(avg(pow(p1 - y, 2)), 6) AS brier FROM pr GROUP BY 1".replace("/ 1000.0", "/ cast(1000 AS DOUBLE)"))
def logloss_brier(s, d):
    return ev.calibration(_predictions(s, d), ["clf"], "p1", "y").select("clf", r6("log_loss"), r6("brier"))


@query(f"WITH {_PRED} SELECT a, b, n, CASE WHEN n >= 10 THEN round(p, 6) END AS p FROM (SELECT cast(p1 > 0.3 AS INT) AS a, cast(clf < '3' AS INT) AS b, count(*) AS n, avg(y) AS p FROM pr GROUP BY 1, 2)")
def condprob_cube(s, d):
    return ev.conditional_cube(_predictions(s, d), {"a": F.col("p1") > 0.3, "b": F.col("clf") < "3"}, "y").select("a", "b", "n", r6("p"))


@query(f"WITH {_PRED}, e AS (SELECT row_id % 10 AS iter, {_cells('p1 > 0.5')} FROM pr GROUP BY 1), f AS (SELECT *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM e) SELECT round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM f")
def metric_summary(s, d):
    per = ev.confusion(_predictions(s, d).withColumn("iter", F.col("row_id") % 10), ["iter"], F.col("p1") > 0.5, F.col("y") == 1)
    return ev.summarise(per, []).select(r6("mean"), r6("std"), "tp", "fp", "fn", "tn")


@query(f"WITH {_PRED} SELECT row_id, round(avg(p), 6) - 0.2 AS p_net, 2 AS classifiers FROM (SELECT row_id, 2 * p1 - 1 AS p FROM pr UNION ALL SELECT row_id, p1 FROM pr) GROUP BY 1".replace("round(avg(p), 6) - 0.2", "round(avg(p) - 0.2, 6)").replace("/ 1000.0", "/ cast(1000 AS DOUBLE)"))
def ensemble_average(s, d):
    p = _predictions(s, d)
    both = p.select("row_id", "y", (2 * F.col("p1") - 1).alias("p_net")).unionAll(p.select("row_id", "y", F.col("p1")))
    return ev.ensemble(both, ["row_id"], offset=-0.2).select("row_id", r6("p_net"), F.col("classifiers").cast("int").alias("classifiers"))


@query(f"WITH {_PRED}, a AS (SELECT row_id, 'x' AS clf, y, p1 FROM pr UNION ALL SELECT row_id, 'z', y, p1 / 2 FROM pr) SELECT row_id, max(y) AS y, round(max(CASE WHEN clf = 'x' THEN p1 END), 6) AS x, round(1 - max(CASE WHEN clf = 'x' THEN p1 END), 6) AS x_not, round(max(CASE WHEN clf = 'z' THEN p1 END), 6) AS z, round(1 - max(CASE WHEN clf = 'z' THEN p1 END), 6) AS z_not FROM a GROUP BY 1".replace("/ 1000.0", "/ cast(1000 AS DOUBLE)"))
def stacked_outputs(s, d):
    p = _predictions(s, d)
    both = p.withColumn("clf", F.lit("x")).unionAll(p.withColumn("clf", F.lit("z")).withColumn("p1", F.col("p1") / 2))
    return ev.stack_outputs(both, ["row_id"], ["x", "z"]).select("row_id", "y", *[r6(c) for c in ("x", "x_not", "z", "z_not")])


@query(f"WITH {_NET}, f AS (SELECT clf, round(threshold, 3) AS threshold, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM sw) SELECT clf, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY clf ORDER BY f1 DESC NULLS LAST, threshold) AS k FROM f WHERE f1 IS NOT NULL) WHERE k = 1".replace("i * 0.025", "cast(i AS DOUBLE) * cast(0.025 AS DOUBLE)").replace("/ 1000.0", "/ cast(1000 AS DOUBLE)"))
def best_thresholds(s, d):
    swept = _sweep(s, d).withColumn("threshold", F.round("threshold", 3)).withColumn("f1", F.round("f1", 9))
    return ev.best_threshold(swept, ["clf"]).select("clf", "threshold", r6("f1"))


@query("SELECT min(t) AS threshold FROM (SELECT o_totalprice AS t FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC LIMIT 100)")
def threshold_pick(s, d):
    return ev.kth_largest(table(s, d, "orders"), "o_totalprice", 100)


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 200000")
def count_guilty(s, d):
    return ev.count_reaching(table(s, d, "orders"), "o_totalprice", 200000.0)


@query(f"WITH {_PRED} SELECT h AS horizon, round(avg(cast((p1 > 0.5) = (y = 1) AS INT)), 6) AS accuracy, count(*) AS n FROM pr, (VALUES (100), (300), (500)) v(h) WHERE row_id < h GROUP BY 1")
def accuracy_by_horizon(s, d):
    return ev.accuracy_by_distance(_predictions(s, d), [100, 300, 500], "row_id", F.col("p1") > 0.5, F.col("y") == 1).select("horizon", r6("accuracy"), "n")


# features and windows -------------------------------------------------------
_FEATS = "fl AS (SELECT p_partkey AS cid, 'size' AS feature, cast(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'log_price', ln(p_retailprice) FROM part UNION ALL SELECT p_partkey, 'brand=' || p_brand, 1.0 FROM part)"


def _features(s, d):
    return feat.to_long(table(s, d, "part").withColumnRenamed("p_partkey", "cid"), "cid", {"size": F.col("p_size"), "log_price": F.log("p_retailprice")}, {"brand": F.col("p_brand")})


@query(f"WITH {_FEATS} SELECT cid, feature, round(value, 6) AS value FROM fl")
def feature_long(s, d):
    return _features(s, d).select("cid", "feature", r6("value"))


_FIT = f"{_FEATS}, n AS (SELECT count(DISTINCT cid) AS e FROM fl), ft AS (SELECT feature, CASE WHEN count(DISTINCT cid) < any_value(e) THEN least(min(value), 0) ELSE min(value) END AS lo, CASE WHEN count(DISTINCT cid) < any_value(e) THEN greatest(max(value), 0) ELSE max(value) END AS hi FROM fl, n GROUP BY 1)"


@query(f"WITH {_FIT} SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS index, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ft")
def feature_vocabulary(s, d):
    return feat.fit(_features(s, d)).select("feature", F.col("index").cast("bigint").alias("index"), r6("lo"), r6("hi"))


@query(f"WITH {_FIT} SELECT cid, feature, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS value FROM fl JOIN ft USING (feature)")
def minmax_scale(s, d):
    long = _features(s, d)
    fitted = feat.fit(long)
    return feat.transform(long, fitted).join(fitted.select("index", "feature"), "index").select("cid", "feature", r6("value"))


@query(f"WITH {_FEATS}, lb AS (SELECT p_partkey AS cid, cast(p_size > 25 AS INT) AS label FROM part), cl AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM lb GROUP BY 1), ob AS (SELECT feature, label, sum(value) AS o FROM fl JOIN lb USING (cid) GROUP BY 1, 2), tt AS (SELECT feature, sum(o) AS t FROM ob GROUP BY 1), cs AS (SELECT t.feature, coalesce(o, 0) AS o, t * p AS e FROM tt t CROSS JOIN cl LEFT JOIN ob ON ob.feature = t.feature AND ob.label = cl.label), sc AS (SELECT feature, sum(pow(o - e, 2) / e) AS chi2 FROM cs WHERE e > 0 GROUP BY 1) SELECT feature, round(chi2, 4) AS chi2 FROM sc ORDER BY sc.chi2 DESC, feature LIMIT 10")
def chi2_topk(s, d):
    labels = table(s, d, "part").select(F.col("p_partkey").alias("cid"), (F.col("p_size") > 25).cast("int").alias("label"))
    return feat.select_best(feat.chi2(_features(s, d), labels), 10).select("feature", F.round("chi2", 4).alias("chi2"))


_HISTORY, _FUTURE, _PLACES = 2000, 500, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
#: Training takes up to 2000 rows, testing 500, at places spread over all rows (as windows.plan draws them at random).
_WIN = f"sz AS (SELECT count(*) AS n, least({_HISTORY}, count(*) - {_FUTURE}) AS h FROM orders), wn AS (SELECT iter, h, h + cast(floor(place * (n - {_FUTURE} - h)) AS BIGINT) AS s FROM sz, (VALUES " + ", ".join(f"({i}, cast({p} AS DOUBLE))" for i, p in enumerate(_PLACES)) + ") v(iter, place) WHERE h > 0)"


def _windows(s, d):
    n = table(s, d, "orders").count()
    h = min(_HISTORY, n - _FUTURE)
    starts = [(i, h + int(p * (n - _FUTURE - h))) for i, p in enumerate(_PLACES)] if h > 0 else []
    return s.createDataFrame([(i, a - h, a, a, a + _FUTURE) for i, a in starts], win.SCHEMA)


def _numbered(s, d):
    o = ordering.dense_order(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "row_id", 16)
    return o.withColumn("row_id", F.col("row_id") - 1)


_NUM = "nb AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders)"


@query(f"WITH {_NUM}, {_WIN} SELECT o_orderkey, iter, CASE WHEN row_id < s THEN 'train' ELSE 'test' END AS part FROM nb, wn WHERE row_id >= s - h AND row_id < s + {_FUTURE}")
def train_test_windows(s, d):
    return win.assign(_numbered(s, d), _windows(s, d)).select("o_orderkey", "iter", "part")


@query(f"WITH {_NUM}, {_WIN} SELECT iter, count(*) AS n, sum(CASE WHEN row_id >= s + {_FUTURE} - 100 THEN 1 ELSE 0 END) AS validate FROM nb, wn WHERE row_id >= s - h AND row_id < s + {_FUTURE} GROUP BY 1")
def three_way_windows(s, d):
    parts = win.assign_three(_numbered(s, d), _windows(s, d), 100)
    return parts.groupBy("iter").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "validate").alias("validate"))


# classification and Python sources ------------------------------------------
_FIXED = "status IN ('Fix Committed', 'Fix Released') AND importance IN ('Critical', 'High', 'Medium', 'Low')"
_CUTOFF = 1_350_000_000
_KINDS = f"""{_CLOSURE}, {CB}, {_LINKS}, ql AS (SELECT cid, bug_id FROM lk JOIN cur_b ON id = bug_id WHERE {_FIXED}),
sc AS (SELECT merge, count(DISTINCT change_id) AS changes FROM bb JOIN cur_c ON cid = node GROUP BY 1),
sb AS (SELECT merge, count(DISTINCT bug_id) AS bugs FROM bb JOIN ql ON cid = node GROUP BY 1),
kd AS (SELECT c.cid, CASE
  WHEN coalesce(c.committed_date, 0) <= {_CUTOFF} THEN 'legacy'
  WHEN coalesce(len(c.parents), 0) = 0 THEN 'root'
  WHEN len(c.parents) = 1 THEN CASE WHEN c.cid IN (SELECT cid FROM ql) THEN 'fast_forward_fix' WHEN c.change_id IS NOT NULL THEN 'fast_forward' ELSE 'unexplained' END
  WHEN coalesce(changes, 0) = 0 AND coalesce(sb.bugs, 0) = 0 THEN 'empty_merge'
  WHEN changes = 1 AND contains(split_part(c.msg, chr(10), 1), 'Revert') AND contains(split_part(p.msg, chr(10), 1), 'Revert') AND p.cid IS NOT NULL AND p.change_id IS NULL THEN 'revert'
  WHEN changes = 1 AND c.change_id IS NOT NULL AND coalesce(len(c.files), 0) = 0 THEN 'own_change'
  WHEN changes = 1 THEN 'simple_merge' ELSE 'complex_merge' END AS kind
FROM cur_c c LEFT JOIN sc ON sc.merge = c.cid LEFT JOIN sb ON sb.merge = c.cid LEFT JOIN cur_c p ON p.cid = c.parents[2] WHERE c.on_master_branch)"""
_WALK = "fp AS (SELECT cid, parents[1] AS up, coalesce(on_master_branch, false) AS main FROM cur_c), wk AS (SELECT cid AS node, cid AS here, 0 AS distance FROM fp UNION SELECT w.node, f.up, w.distance + 1 FROM wk w JOIN fp f ON f.cid = w.here WHERE NOT f.main AND f.up IN (SELECT cid FROM fp) AND w.distance < (SELECT count(*) FROM fp)), an AS (SELECT node, here AS stop FROM wk JOIN fp f ON f.cid = wk.here WHERE f.main)"
_ENTRIES = f"""{_KINDS}, {_WALK},
bt AS (SELECT DISTINCT merge, node, bug_id FROM bb JOIN ql ON ql.cid = node),
ch AS (SELECT cid AS child, parents[1] AS base, committed_date AS born, unnest(parents) AS node FROM cur_c WHERE on_master_branch),
fc AS (SELECT node, child, base FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY born NULLS LAST, child) AS k FROM ch) WHERE k = 1),
en AS (
  SELECT k.cid, k.cid AS diff_commit, c.parents[1] AS blame_commit, 'fast_forward' AS type, k.cid AS merge_commit, bug_id FROM kd k JOIN cur_c c USING (cid) JOIN (SELECT DISTINCT cid, bug_id FROM ql) USING (cid) WHERE kind = 'fast_forward_fix'
  UNION ALL SELECT c.parents[2], c.parents[2], an.stop, 'simple_merge', k.cid, b.bug_id FROM kd k JOIN cur_c c USING (cid) JOIN (SELECT DISTINCT merge, bug_id FROM bt) b ON b.merge = k.cid LEFT JOIN an ON an.node = c.parents[2] WHERE kind = 'simple_merge'
  UNION ALL SELECT n.cid, CASE WHEN p.on_master_branch THEN n.cid WHEN fc.child IS NOT NULL THEN fc.child ELSE n.cid END, CASE WHEN p.on_master_branch THEN n.parents[1] WHEN fc.child IS NOT NULL THEN fc.base ELSE n.parents[1] END,
    CASE WHEN p.on_master_branch THEN 'complex_merge_1' WHEN fc.child IS NOT NULL THEN 'complex_merge_2' ELSE 'complex_merge_3' END, k.cid, b.bug_id
    FROM kd k JOIN bt b ON b.merge = k.cid JOIN cur_c n ON n.cid = b.node LEFT JOIN cur_c p ON p.cid = n.parents[1] LEFT JOIN fc ON fc.node = n.cid
    WHERE kind = 'complex_merge' AND n.change_id IS NOT NULL AND (coalesce(p.on_master_branch, false) OR fc.child IS NOT NULL OR len(n.parents) = 1))"""


def _counted(s, d, c):
    b = bugs(s, d)
    return bugfix.qualified_links(joins.commit_bug_links(c, b), b)


def _kinds(s, d, c, links, closure):
    return bugfix.classify(c, bugfix.side_stats(closure, c, links), links, _CUTOFF, "committed_date")


@query(f"WITH RECURSIVE {_KINDS} SELECT cid, kind FROM kd")
def commit_kinds(s, d):
    c = commits(s, d)
    return _kinds(s, d, c, _counted(s, d, c), _closure(s, d))


def _entries(s, d):
    c = commits(s, d)
    links, closure = _counted(s, d, c), _closure(s, d)
    main = c.filter("coalesce(on_master_branch, false)").select(F.col("cid").alias("node"))
    return bugfix.guilt_entries(_kinds(s, d, c, links, closure), c, links, graph.walk_to(graph.first_parents(c), main), closure, "committed_date")


@query(f"WITH RECURSIVE {_ENTRIES} SELECT cid, diff_commit, blame_commit, type, merge_commit, bug_id FROM en")
def fix_comparisons(s, d):
    return _entries(s, d)


@query(f"WITH RECURSIVE {_ENTRIES}, wt AS (SELECT en.*, {SEVERITY_SQL.format('importance')} AS w FROM en JOIN cur_b ON id = bug_id) SELECT cid, diff_commit, merge_commit, type, bug_id, greatest(max(w) OVER (PARTITION BY cid, diff_commit, blame_commit, type, merge_commit) - 1, 0) AS weight FROM wt")
def fix_weights(s, d):
    return bugfix.entry_weights(_entries(s, d), bugs(s, d), "med+").select("cid", "diff_commit", "merge_commit", "type", "bug_id", "weight")


@query()
def python_metrics(s, d):
    b = table(s, d, "blobs").filter("lower(path) like '%.py'").dropDuplicates(["blob_id"])
    return lang.file_metrics(b, ["blob_id", "project", "cid", "path"]).select("blob_id", "nodes", "cc", "lloc", "sloc", "functions", "classes", F.round("halstead", 4).alias("halstead"), F.round("mi", 4).alias("mi"), "max_depth", "invalid")


@query()
def python_metric_rollup(s, d):
    b = table(s, d, "blobs").filter("lower(path) like '%.py'").dropDuplicates(["blob_id"])
    return lang.aggregate_metrics(lang.file_metrics(b, ["cid", "path"])).select("cid", "cc", "test_cc", "lloc", "test_lloc", "nodes", "test_nodes", F.round("avg_depth", 6).alias("avg_depth"), "max_depth", "invalid")


@query()
def python_node_types(s, d):
    b = table(s, d, "blobs").filter("lower(path) like '%.py'").dropDuplicates(["blob_id"])
    return lang.type_counts(b, "blob_id").groupBy("node_type").agg(F.sum("n").alias("n"))


@query()
def python_changes(s, d):
    """Versions of one path, each against the one before."""
    from pyspark.sql import Window

    b = table(s, d, "blobs").filter("lower(path) like '%.py' and content is not null").dropDuplicates(["blob_id"])
    w = Window.partitionBy("project", "path").orderBy("ingested_at", "blob_id")
    pairs = b.withColumn("old", F.lag("content").over(w)).filter("old is not null")
    return lang.pair_changes(pairs, ["blob_id"], "old", "content").select("blob_id", "invalid", "changes", "cc", "new_functions", "new_classes", F.size("ranges").alias("ranges"))


@query()
def raw_change_records(s, d):
    raw = table(s, d, "raw_lines").filter("line is not null")
    return jsonl.parse_records(raw, "line", "change_id string, _number int").select("change_id", "_number", "json_key")


# models on time-ordered windows ---------------------------------------------
def _labelled(s, d):
    from pyspark.ml.functions import array_to_vector

    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") >= 5).cast("int").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _plan(s, d, iterations=2):
    return win.plan(s, table(s, d, "embeddings").count(), 300, 100, iterations, seed=7)


@query()
def model_window_scores(s, d):
    """Logistic regression trained on history, applied to the future."""
    from ..ml import experiments

    return experiments.window_scores(_labelled(s, d), _plan(s, d), "logistic").select("clf", "iter", "row_id", "y", r6("p1"))


@query()
def model_comparison(s, d):
    """Mean and deviation of F1 of several classifiers over the same windows."""
    from ..ml import experiments

    data, plan = _labelled(s, d), _plan(s, d)
    out = None
    for name in ("logistic", "tree", "forest", "bayes"):
        one = ev.summarise(experiments.evaluate_windows(experiments.window_scores(data, plan, name)), ["clf"])
        out = one if out is None else out.unionAll(one)
    return out.select("clf", r6("mean"), r6("std"), "tp", "fp", "fn", "tn")


@query()
def model_boosted_stumps(s, d):
    from ..ml import models

    data = _labelled(s, d)
    return models.boosted_scores(models.boost(data, 5), data, ["row_id", "label"]).select("row_id", "label", r6("p1"))
