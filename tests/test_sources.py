import gzip
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from commitloom.langdiff import metrics
from commitloom.sources import git, jsonl, sinks, tracker
from commitloom.sources.config import Project, Registry
from commitloom.streaming import incremental


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    env = {"GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "C D", "GIT_COMMITTER_EMAIL": "c@d.e", "GIT_CONFIG_GLOBAL": "/dev/null", "PATH": "/usr/bin:/bin:/usr/local/bin"}

    def run(*args, date="2020-01-01T00:00:00Z"):
        subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date})

    run("init", "-q", "-b", "master")
    (path / "a.py").write_text("one\ntwo\nthree\n")
    (path / "b.txt").write_text("x\n")
    run("add", ".")
    run("commit", "-q", "-m", "First\n\nChange-Id: I" + "a" * 40)
    (path / "a.py").write_text("one\nTWO\nthree\nfour\n")
    (path / "c d.sh").write_text("echo\n")
    (path / "b.txt").unlink()
    run("add", "-A")
    run("commit", "-q", "-m", "Fixes bug 12345", date="2020-01-02T00:00:00Z")
    run("checkout", "-q", "-b", "side")
    (path / "a.py").write_text("one\n")
    run("commit", "-q", "-am", "Side", date="2020-01-03T00:00:00Z")
    return str(path)


def test_git_log_files_trees(spark, repository):
    commits = git.read_commits(spark, repository).cache()
    rows = {r.msg.split("\n")[0]: r for r in commits.collect()}
    assert rows["First"].change_id == "I" + "a" * 40 and rows["Fixes bug 12345"].bugs == ["12345"] and not rows["Side"].on_master_branch and rows["First"].on_master_branch
    assert rows["First"].author == '<git.Actor "A B <a@b.c>">' and rows["First"].parents == []
    files = git.changed_files(commits, repository)
    assert {(r.status, r.path) for r in files.filter(F.col("cid") == rows["Fixes bug 12345"].cid).collect()} == {("M", "a.py"), ("A", "c d.sh"), ("D", None)}
    kept = {r.cid: r.files for r in git.kept_files(files).collect()}
    assert kept[rows["First"].cid] == ["a.py", "b.txt"]
    tree = {r.path for r in git.tree_files(commits.filter("msg = 'Side'"), repository).collect()}
    assert tree == {"a.py", "c d.sh"}
    assert git.read_commits(spark, repository, known=commits).count() == 0
    assert git.head_commit(repository) == rows["Fixes bug 12345"].cid


def test_git_blame_and_diffs(spark, repository):
    commits = {r.msg.split("\n")[0]: r.cid for r in git.read_commits(spark, repository).collect()}
    asked = spark.createDataFrame([(commits["Fixes bug 12345"], "a.py", None, None), (commits["Fixes bug 12345"], "a.py", 2, 2), (commits["First"], "nope", None, None)], "cid string, path string, start int, end int")
    rows = git.blame(asked, repository).collect()
    assert {(r.lineno, r.cid) for r in rows if r.status == "ok"} == {(1, commits["First"]), (2, commits["Fixes bug 12345"]), (3, commits["First"]), (4, commits["Fixes bug 12345"])}
    assert [r.status for r in rows if r.path == "nope"] == ["error"]
    pairs = spark.createDataFrame([(commits["Fixes bug 12345"], commits["First"])], "diff_commit string, blame_commit string")
    assert {r.path for r in git.diffs(pairs, repository).collect()} == {"a.py", "b.txt", "c d.sh"}


def test_from_a_fix_to_the_commits_it_replaced(spark, repository):
    from commitloom.operators import blame, guilt

    commits = {r.msg.split("\n")[0]: r.cid for r in git.read_commits(spark, repository).collect()}
    pairs = spark.createDataFrame([(commits["Side"], commits["Fixes bug 12345"])] * 2, "diff_commit string, blame_commit string")
    lines = blame.blame_of_fixes(pairs, repository, 1).cache()
    assert {(r.lineno, r.commit) for r in lines.collect()} == {(2, commits["Fixes bug 12345"]), (3, commits["First"]), (4, commits["Fixes bug 12345"])}
    shares = {r.commit: r.guilt for r in guilt.normalised(lines, ["diff_commit"], "commit").collect()}
    assert abs(shares[commits["First"]] - 1 / 3) < 1e-9
    samples = spark.createDataFrame([(commits["Side"],)], "node string")
    assert {r.cid for r in blame.reachable_from(samples, repository).collect()} == {commits["First"], commits["Fixes bug 12345"]}
    old, new = "a = 1\nb = 2\nc = 3\n", "a = 1\nb = 9\nc = 3\n"
    trees = spark.createDataFrame([("x", "y", "a.py", old, new)], "diff_commit string, blame_commit string, path string, source_parent string, source_new string")
    found = blame.changed_tree_lines(trees)
    assert [(r.lineno, r.proximity) for r in found.collect()] == [(2, 1)]
    assert [r.status for r in blame.blame_status(found, spark.createDataFrame([("y", "a.py", "error")], "at string, path string, status string")).collect()] == ["error"]


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"a": 1, "json_key": "k1"}), json.dumps({"json_key": "k2", "json_tombstone": True}), "{broken", ""]
    for name in ("x.jsonz", "x.json"):
        raw = "\n".join(lines).encode()
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("z") else raw)
        assert [(r.a, r.json_key) for r in jsonl.read_records(spark, str(tmp_path / name), "a int").collect()] == [(1, "k1")]
    (tmp_path / "empty.jsonz").write_bytes(b"")
    assert jsonl.read_records(spark, str(tmp_path / "empty.jsonz"), "a int").count() == 0
    df = spark.createDataFrame([("p", 1), ("q", None)], "k string, v int")
    jsonl.write_records(df, str(tmp_path / "out"), "k")
    back = jsonl.read_records(spark, str(tmp_path / "out"), "k string, v int")
    assert [tuple(r) for r in back.collect()] == [("p", 1, "p")]


def test_csv_sink_and_config(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.123456789, 2), ("b", None, 1)], "cid string, guilt double, order int")
    assert {tuple(r) for r in sinks.info_rows(rows).collect()} == {("a", "0.12345679", "2"), ("b", "null", "1")}
    sinks.write_csv(rows, str(tmp_path / "csv"), "order")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    known = Registry()
    known.add(Project("x", corpus="/c/"))
    assert known.table_path("x", "commits") == "/c/x/commits"
    with pytest.raises(KeyError):
        known.get("y")


def test_tracker_pages(spark):
    df = spark.createDataFrame([(i, f"{i:04x}") for i in range(10)], "_number int, _sortkey string")
    first = tracker.page_after(df, None, 4).collect()
    second = tracker.page_after(df, first[-1]._sortkey, 4).collect()
    assert [r._number for r in first + second] == [9, 8, 7, 6, 5, 4, 3, 2]


def test_stream_merges_new_rows(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(str(src / "1"))
    stream = spark.readStream.schema("k string, v int").option("recursiveFileLookup", "true").parquet(str(src))
    incremental.merge_new(stream, table, "k", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int").write.parquet(str(src / "2"))
    incremental.merge_new(stream, table, "k", str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(table).collect()} == {("a", 1), ("b", 2), ("c", 3)}


OLD = 'def f(a):\n    """Doc."""\n    return a\n\n\nclass K:\n    def m(self):\n        return 1\n'


@pytest.mark.parametrize(
    ("new", "want"),
    [
        (OLD, (0, 0, 0, [])),
        (OLD.replace("Doc.", "Other doc."), (0, 0, 0, [])),
        (OLD.replace("return a", "return a  # comment"), (0, 0, 0, [])),
        (OLD + "\n\ndef g():\n    return 2\n", (None, 1, 0, [])),
        (OLD.replace("return 1", "return 2"), (None, 0, 0, [(8, 8)])),
        (OLD.replace("return a", "try:\n        return a\n    except ValueError:\n        return 0"), (None, 0, 0, [])),
        (OLD + "\n\nclass L:\n    x = 1\n", (None, 0, 1, [])),
    ],
)
def test_tree_changes(new, want):
    got = metrics.compare(OLD, new)
    assert (got["new_functions"], got["new_classes"], got["ranges"]) == want[1:]
    assert got["changes"] == 0 if want[0] == 0 else got["changes"] > 0


def test_tree_errors_and_metrics(spark):
    assert metrics.compare("print 'x'", OLD)["invalid"] and metrics.compare(None, OLD)["new_functions"] == 2
    assert metrics.measure("") ["nodes"] == 1 and metrics.measure("x = (") is None
    df = spark.createDataFrame([("c", "a/x.py", OLD), ("c", "tests/y.py", "def t():\n    pass\n"), ("d", "z.py", "x ="), ("d", "n.py", None)], "cid string, path string, content string")
    rows = {r.cid: r for r in metrics.aggregate_metrics(metrics.file_metrics(df, ["cid", "path"])).collect()}
    assert rows["c"].lloc == 6 and rows["c"].test_lloc == 2 and not rows["c"].invalid and rows["d"].invalid
