"""How fixes are found: kinds of mainline commits and what is compared for each."""

from commitloom.operators import bugfix, graph

COMMIT = "cid string, parents array<string>, change_id string, on_master_branch boolean, date bigint, msg string, files array<string>"
#: root - ff fix - ff - merges of: one change; a branch of two fixes from the mainline; a branch from nowhere; nothing; a revert; its own change
ROWS = [
    ("root", [], None, True, 10, "Start", ["a"]),
    ("old", ["root"], None, True, 1, "Legacy", ["a"]),
    ("ff_fix", ["root"], "I1", True, 11, "Fix", ["a"]),
    ("ff", ["ff_fix"], "I2", True, 12, "Go on", ["a"]),
    ("bare", ["ff"], None, True, 13, "No id", ["a"]),
    ("s1", ["ff"], "I3", False, 13, "Side", ["a"]),
    ("simple", ["bare", "s1"], None, True, 14, "Merge", []),
    ("c1", ["bare"], "I4", False, 14, "From the mainline", ["a"]),
    ("c2", ["c1"], "I5", False, 15, "On top", ["a"]),
    ("complex", ["simple", "c2"], None, True, 16, "Merge", []),
    ("x0", ["stable"], "I6", False, 15, "Deep", ["a"]),
    ("x1", ["x0"], "I7", False, 16, "Other", ["a"]),
    ("octopus", ["complex", "x1", "c1"], None, True, 17, "Merge", []),
    ("n1", ["complex"], None, False, 17, "Nothing", ["a"]),
    ("empty", ["octopus", "n1"], None, True, 18, "Merge", []),
    ("r0", ["octopus"], "I8", False, 18, "Reverted", ["a"]),
    ("r1", ["r0"], None, False, 18, "Revert it", ["a"]),
    ("revert", ["empty", "r1"], None, True, 19, "Revert it", []),
    ("o1", ["octopus"], "I9", False, 19, "Own", ["a"]),
    ("own", ["revert", "o1"], "I9", True, 20, "Merge", []),
]
LINKS = [("ff_fix", "1"), ("s1", "2"), ("c1", "3"), ("c2", "4"), ("x0", "5"), ("x1", "5"), ("ff_fix", "6")]


def found(spark):
    c = spark.createDataFrame(ROWS, COMMIT)
    links = spark.createDataFrame(LINKS, "cid string, bug_id string")
    main = c.filter("on_master_branch").selectExpr("cid as node")
    merges = c.filter("on_master_branch and size(parents) >= 2").selectExpr("cid as merge", "parents[1] as node")
    closure = graph.branch_closure(merges, c.selectExpr("cid as child", "explode(parents) as parent"), main)
    kinds = bugfix.classify(c, bugfix.side_stats(closure, c, links), links, 5)
    return kinds, bugfix.guilt_entries(kinds, c, links, graph.walk_to(graph.first_parents(c), main), closure)


def test_kinds(spark):
    kinds, _ = found(spark)
    want = {"root": "root", "old": "legacy", "ff_fix": "fast_forward_fix", "ff": "fast_forward", "bare": "unexplained", "simple": "simple_merge", "complex": "complex_merge", "octopus": "complex_merge", "empty": "empty_merge", "revert": "revert", "own": "own_change"}
    assert {r.cid: r.kind for r in kinds.collect()} == want


def test_three_ways_to_choose_the_base(spark):
    _, entries = found(spark)
    want = {
        ("ff_fix", "ff_fix", "root", "fast_forward", "ff_fix", "1"),
        ("ff_fix", "ff_fix", "root", "fast_forward", "ff_fix", "6"),
        ("s1", "s1", "ff", "simple_merge", "simple", "2"),
        ("c1", "c1", "bare", "complex_merge_1", "complex", "3"),
        ("c2", "complex", "simple", "complex_merge_2", "complex", "4"),
        ("x0", "x0", "stable", "complex_merge_3", "octopus", "5"),
        ("x1", "octopus", "complex", "complex_merge_2", "octopus", "5"),
    }
    assert {tuple(r) for r in entries.collect()} == want


def test_weights(spark):
    _, entries = found(spark)
    bugs = spark.createDataFrame([("1", "High"), ("6", "Critical"), ("2", "Low"), ("3", None), ("4", "Medium"), ("5", "High")], "id string, importance string")
    got = {(r.cid, r.bug_id): r.weight for r in bugfix.entry_weights(entries, bugs, "med+").collect()}
    assert got == {("ff_fix", "1"): 3, ("ff_fix", "6"): 3, ("s1", "2"): 0, ("c1", "3"): 0, ("c2", "4"): 1, ("x0", "5"): 2, ("x1", "5"): 2}
