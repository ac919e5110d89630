"""Queries of the general problems: nested records, orphan references, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import walk_to
from ..operators.hierarchy import commit_links, contradicted, descendants, hierarchy, paths
from ..operators.nested import flatten_json
from ..operators.orphans import orphan_report, repository_orphans
from ..runtime import current_rows, table, undeleted

NESTED_FIELDS = ["labels", "messages"]


def _nested(spark: SparkSession, d: str, with_json: bool = False) -> DataFrame:
    details = table(spark, d, "change_details").select("_number", "labels", "messages", "ingested_at", "tombstone")
    details = undeleted(current_rows(details, ["_number"])).select(F.col("_number").alias("k"), F.to_json(F.struct("labels", "messages")).alias("text"))
    bugs = table(spark, d, "bugs").select("id", "messages", "ingested_at", "tombstone")
    bugs = undeleted(current_rows(bugs, ["id"])).select(F.col("id").alias("k"), F.to_json(F.struct("messages")).alias("text"))
    raw = table(spark, d, "raw_lines").select(F.col("rec_no").alias("k"), F.col("line").alias("text"))
    parts = [flatten_json(df, "k", "text", fields, trusted, with_json).withColumn("src_table", F.lit(name)) for df, name, fields, trusted in ((details, "change_details", NESTED_FIELDS, True), (bugs, "bugs", ["messages"], True), (raw, "raw_lines", NESTED_FIELDS, False))]
    return reduce(DataFrame.unionAll, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).select("src_table", "parent_key", "child_path")


def p1_typed_tables(spark: SparkSession, d: str) -> DataFrame:
    """The objects of the typed tables alone."""
    return _nested(spark, d).filter("src_table <> 'raw_lines'").select("src_table", "parent_key", "child_path")


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """All child rows with the link to their parent child."""
    return _nested(spark, d).select("src_table", "parent_key", "child_path", "parent_path", "field", "name", "pos")


def p1_votes(spark: SparkSession, d: str) -> DataFrame:
    """The typed child table of votes, linked to record and label."""
    votes = _nested(spark, d, with_json=True).filter(F.col("child_path").rlike("^labels/.*/all/[0-9]+$"))
    vote = F.from_json("json", "_account_id int, name string, value int")
    return votes.select("src_table", "parent_key", "parent_path", "child_path", "pos", vote["_account_id"].alias("account_id"), vote["name"].alias("voter"), vote["value"].alias("vote"))


def p1_replies(spark: SparkSession, d: str) -> DataFrame:
    """The typed child table of replies to comments, of any depth, linked to the comment or reply above."""
    replies = _nested(spark, d, with_json=True).filter(F.col("child_path").rlike("/replies/[0-9]+$"))
    reply = F.from_json("json", "message string, unresolved boolean")
    return replies.select("src_table", "parent_key", "parent_path", "child_path", "pos", reply["message"].alias("message"), reply["unresolved"].alias("unresolved"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return repository_orphans(table(spark, d, "commits"), table(spark, d, "changes"), table(spark, d, "bugs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "src_key", "ref_field", "ref_value")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan with its reason."""
    return _orphans(spark, d).select("src_table", "src_key", "ref_field", "ref_value", "reason")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(commit_links(table(spark, d, "commits")))
    return tree.select(F.col("node").alias("cid"), F.col("root").alias("root_cid"), "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of each commit, from its root, joined by blanks."""
    found = paths(commit_links(table(spark, d, "commits")))
    return found.select(F.col("node").alias("cid"), F.array_join("path", " ").alias("path"), "depth")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a commit and a commit below it."""
    return descendants(commit_links(table(spark, d, "commits"))).select(F.col("ancestor").alias("cid"), F.col("descendant").alias("descendant_cid"), "distance")


def p4_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Distances to the mainline recorded by an earlier run that the links contradict."""
    commits = table(spark, d, "commits")
    now = undeleted(current_rows(commits.select("cid", "on_master_branch", F.col("distance_from_mainline").alias("recorded"), "ingested_at", "tombstone"), ["cid"]))
    links = commit_links(commits)
    actual = walk_to(links, now.filter("on_master_branch").select(F.col("cid").alias("node"))).select("node", F.col("distance").alias("actual"))
    recorded = now.filter("recorded <> 1000000").select(F.col("cid").alias("node"), "recorded").join(actual, "node")
    return contradicted(hierarchy(links), recorded).select(F.col("node").alias("cid"), "depth", "recorded")


QUERIES = {f.__name__: f for f in (p1_found, p1_typed_tables, p1_links, p1_votes, p1_replies, p2_found, p2_reasons, p2_by_month, p4_found, p4_paths, p4_descendants, p4_recorded)}

_P4_LINKS = """
WITH RECURSIVE cur AS (SELECT cid, parents[1] AS up, coalesce(tombstone, false) AS dead, row_number() OVER (PARTITION BY cid ORDER BY ingested_at DESC, parents[1] DESC NULLS LAST) AS rn FROM commits),
live AS (SELECT cid, lower(trim(up)) AS up FROM cur WHERE rn = 1 AND NOT dead),
link AS (SELECT l.cid, p.cid AS parent FROM live l LEFT JOIN live p ON lower(p.cid) = l.up),
tree AS (SELECT cid, cid AS root_cid, 0 AS depth FROM link WHERE parent IS NULL UNION ALL SELECT l.cid, t.root_cid, t.depth + 1 FROM tree t JOIN link l ON l.parent = t.cid),
loose AS (SELECT * FROM link WHERE cid NOT IN (SELECT cid FROM tree)),
reach AS (SELECT cid, parent AS hit FROM loose UNION SELECT r.cid, l.parent FROM reach r JOIN loose l ON l.cid = r.hit),
ring AS (SELECT cid FROM reach WHERE cid = hit)
"""

_P2 = """
WITH ch AS (SELECT 'I' || lower(regexp_extract(max(change_id), '[Ii]([0-9A-Fa-f]{40})', 1)) AS target, min(ingested_at) AS first_at, arg_max(coalesce(tombstone, false), ingested_at) AS dead FROM changes GROUP BY _number),
bg AS (SELECT regexp_extract(id, '0*(\\d+)\\D*$', 1) AS target, min(ingested_at) AS first_at, arg_max(coalesce(tombstone, false), ingested_at) AS dead FROM bugs GROUP BY id),
cm AS (SELECT lower(cid) AS target, min(ingested_at) AS first_at, arg_max(coalesce(tombstone, false), ingested_at) AS dead FROM commits GROUP BY cid),
uses AS (
  SELECT 'commits' AS src_table, cid AS src_key, 'change_id' AS ref_field, change_id AS ref_value, ingested_at AS seen FROM commits
  UNION ALL SELECT 'commits', cid, 'bugs', unnest(bugs), ingested_at FROM commits
  UNION ALL SELECT 'bugs', id, 'commits.cid', c.cid, ingested_at FROM (SELECT id, unnest(commits) AS c, ingested_at FROM bugs)
  UNION ALL SELECT 'bugs', id, 'commits.change_id', c.change_id, ingested_at FROM (SELECT id, unnest(commits) AS c, ingested_at FROM bugs)),
alive AS (SELECT 'commits' AS src_table, target AS src_key FROM cm WHERE NOT dead UNION ALL SELECT 'bugs', id FROM (SELECT id, arg_max(coalesce(tombstone, false), ingested_at) AS dead FROM bugs GROUP BY id) WHERE NOT dead),
made AS (
  SELECT u.src_table, u.src_key, ref_field, ref_value, min(seen) AS made_at,
    CASE WHEN ref_field IN ('change_id', 'commits.change_id') THEN 'I' || lower(regexp_extract(ref_value, '[Ii]([0-9A-Fa-f]{40})', 1))
         WHEN ref_field = 'bugs' THEN regexp_extract(ref_value, '0*(\\d+)\\D*$', 1)
         ELSE lower(regexp_extract(ref_value, '(?:^|[^0-9A-Za-z])([0-9A-Fa-f]{4,40})[^0-9A-Za-z]*$', 1)) END AS want
  FROM uses u SEMI JOIN alive a ON a.src_table = u.src_table AND a.src_key = u.src_key
  WHERE trim(regexp_replace(ref_value, '\\s+', ' ', 'g')) <> '' GROUP BY ALL),
met AS (
  SELECT m.src_table, m.src_key, m.ref_field, m.ref_value, m.made_at, t.first_at, t.dead FROM made m LEFT JOIN ch t ON m.want = t.target WHERE ref_field IN ('change_id', 'commits.change_id')
  UNION ALL SELECT m.src_table, m.src_key, m.ref_field, m.ref_value, m.made_at, t.first_at, t.dead FROM made m LEFT JOIN bg t ON m.want = t.target WHERE ref_field = 'bugs'
  UNION ALL SELECT m.src_table, m.src_key, m.ref_field, m.ref_value, m.made_at, t.first_at, t.dead FROM made m LEFT JOIN cm t ON m.want <> '' AND t.target LIKE m.want || '%' WHERE ref_field = 'commits.cid'),
found AS (SELECT src_table, src_key, ref_field, ref_value, made_at, CASE WHEN count(first_at) = 0 THEN 'missing' WHEN bool_and(dead) THEN 'deleted' WHEN min(first_at) > made_at THEN 'late' END AS reason FROM met GROUP BY ALL)
"""
_P2 = _P2.replace("GROUP BY ALL)\n", "GROUP BY src_table, src_key, ref_field, ref_value, made_at)\n")

_P1 = """
WITH cd AS (SELECT * FROM (SELECT _number, labels, messages, coalesce(tombstone, false) AS dead, row_number() OVER (PARTITION BY _number ORDER BY ingested_at DESC) AS rn FROM change_details) WHERE rn = 1 AND NOT dead),
bg AS (SELECT * FROM (SELECT id, messages, coalesce(tombstone, false) AS dead, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM bugs) WHERE rn = 1 AND NOT dead),
lab AS (SELECT _number, unnest(map_entries(labels)) AS e FROM cd),
msg AS (SELECT _number, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS i FROM cd),
com AS (SELECT _number, i, unnest(m.comments) AS c, generate_subscripts(m.comments, 1) - 1 AS j FROM msg),
rep AS (SELECT _number, i, j, unnest(c.replies) AS r, generate_subscripts(c.replies, 1) - 1 AS k FROM com),
bms AS (SELECT id, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS i FROM bg),
att AS (SELECT id, i, unnest(m.attachments) AS a, generate_subscripts(m.attachments, 1) - 1 AS j FROM bms)
SELECT 'change_details' AS src_table, CAST(_number AS VARCHAR) AS parent_key, 'labels/' || e.key AS child_path FROM lab WHERE e.value IS NOT NULL
UNION ALL SELECT 'change_details', CAST(_number AS VARCHAR), 'labels/' || e.key || '/approved' FROM lab WHERE e.value.approved IS NOT NULL
UNION ALL SELECT 'change_details', CAST(_number AS VARCHAR), 'labels/' || e.key || '/recommended' FROM lab WHERE e.value.recommended IS NOT NULL
UNION ALL SELECT 'change_details', CAST(_number AS VARCHAR), 'labels/' || k || '/all/' || i FROM (SELECT _number, e.key AS k, unnest(e.value.all) AS v, generate_subscripts(e.value.all, 1) - 1 AS i FROM lab) WHERE v IS NOT NULL
UNION ALL SELECT 'change_details', CAST(_number AS VARCHAR), 'messages/' || i FROM msg WHERE m IS NOT NULL
UNION ALL SELECT 'change_details', CAST(_number AS VARCHAR), 'messages/' || i || '/comments/' || j FROM com WHERE c IS NOT NULL
UNION ALL SELECT 'change_details', CAST(_number AS VARCHAR), 'messages/' || i || '/comments/' || j || '/replies/' || k FROM rep WHERE r IS NOT NULL
UNION ALL SELECT 'bugs', id, 'messages/' || i FROM bms WHERE m IS NOT NULL
UNION ALL SELECT 'bugs', id, 'messages/' || i || '/attachments/' || j FROM att WHERE a IS NOT NULL
"""

ORACLE = {
    "p1_typed_tables": _P1,
    "p2_found": _P2 + "SELECT src_table, src_key, ref_field, ref_value FROM found WHERE reason IS NOT NULL",
    "p2_reasons": _P2 + "SELECT src_table, src_key, ref_field, ref_value, reason FROM found WHERE reason IS NOT NULL",
    "p2_by_month": _P2 + "SELECT src_table, ref_field, strftime(made_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p4_found": _P4_LINKS + "SELECT cid, root_cid, depth FROM tree UNION ALL SELECT r.cid, min(r.hit), -1 FROM reach r JOIN ring g ON g.cid = r.hit GROUP BY r.cid",
    "p4_recorded": _P4_LINKS
    + """, now AS (SELECT cid, on_master_branch AS main, distance_from_mainline AS recorded FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ingested_at DESC) AS k FROM commits) WHERE k = 1 AND NOT coalesce(tombstone, false)),
walk AS (SELECT cid AS node, cid AS here, 0 AS d FROM link UNION SELECT w.node, l.parent, w.d + 1 FROM walk w JOIN link l ON l.cid = w.here WHERE w.here NOT IN (SELECT cid FROM now WHERE main) AND l.parent IS NOT NULL AND w.d < (SELECT count(*) FROM link))
SELECT t.cid, t.depth, n.recorded FROM tree t JOIN now n ON n.cid = t.cid JOIN walk w ON w.node = t.cid JOIN now m ON m.cid = w.here AND m.main WHERE n.recorded <> 1000000 AND n.recorded <> w.d""",
    "p4_paths": _P4_LINKS + ", way AS (SELECT cid, cid AS path, 0 AS depth FROM link WHERE parent IS NULL UNION ALL SELECT l.cid, w.path || ' ' || l.cid, w.depth + 1 FROM way w JOIN link l ON l.parent = w.cid) SELECT cid, path, depth FROM way UNION ALL SELECT cid, NULL, -1 FROM loose",
    "p4_descendants": _P4_LINKS + ", down AS (SELECT parent AS cid, cid AS descendant_cid, 1 AS distance FROM link WHERE parent IS NOT NULL AND cid IN (SELECT cid FROM tree) UNION ALL SELECT l.parent, d.descendant_cid, d.distance + 1 FROM down d JOIN link l ON l.cid = d.cid WHERE l.parent IS NOT NULL) SELECT cid, descendant_cid, distance FROM down",
}
