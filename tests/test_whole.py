"""Queries do the whole job: nothing made up, cut at a fixed depth or left out."""

import datetime as dt
import random

from commitloom.operators import graph
from commitloom.queries import reference as R

T = dt.datetime(2020, 1, 1)
COMMIT = "cid string, parents array<string>, msg string, on_master_branch boolean, ingested_at timestamp_ntz, tombstone boolean"


def test_cherry_links_come_from_the_messages(spark, tmp_path):
    a, b, c, gone = ("a" * 40, "b" * 40, "c" * 40, "d" * 40)
    picked = "Fix it\n\n(cherry picked from commit {})".format
    rows = [(a, [], "Start", True), (b, [a], "Go on", True), (c, [b], picked(a), True), ("e" * 40, [b], picked(gone), True), ("f" * 40, [b], picked(a), False), ("0" * 40, [b], None, True)]
    spark.createDataFrame([(*r, T, None) for r in rows], COMMIT).write.parquet(str(tmp_path / "commits.parquet"))
    assert [tuple(r) for r in R.cherry_links(spark, str(tmp_path)).select("cid", "picked_from").collect()] == [(c, a)]


def test_side_branches_are_walked_to_their_end(spark, tmp_path):
    chain = [(f"s{i}", [f"s{i + 1}"] if i < 399 else ["base"], "", False) for i in range(400)]
    rows = [("base", [], "", True), ("m", ["base", "s0"], "", True), *chain]
    spark.createDataFrame([(*r, T, None) for r in rows], COMMIT).write.parquet(str(tmp_path / "commits.parquet"))
    got = {r.node: r.depth for r in R.branch_closure(spark, str(tmp_path)).collect()}
    assert got == {f"s{i}": i + 1 for i in range(400)}


def test_closure_by_brute_force_and_cycles(spark):
    rng = random.Random(11)
    edges = {(i, j) for i in range(40) for j in rng.sample(range(i + 1, 60), 2)} | {(i, i + 1) for i in range(20)} | {(70, 71), (71, 72), (72, 71), (72, 73), (73, "main"), (80, 80)}
    merges = {("m1", 0), ("m2", 17), ("m3", 70), ("m4", 80), ("m5", "main"), ("m6", 73)}
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    want = {}
    for m, start in merges - {("m5", "main")}:
        level, depth = {start}, 1
        while level and depth < 200:
            want |= {(m, str(n)): depth if depth < 100 else None for n in level}
            level, depth = {p for n in level for p in up.get(n, ()) if p != "main"}, depth + 1
    want["m3", "70"] = 1
    df = spark.createDataFrame([(m, str(n)) for m, n in merges], "merge string, node string")
    links = spark.createDataFrame([(str(a), str(b)) for a, b in edges] + [("main", "0")], "child string, parent string")
    got = graph.branch_closure(df, links, spark.createDataFrame([("main",)], "node string"))
    assert {(r.merge, r.node): r.depth for r in got.collect()} == want
    near = {r.node: r.merge for r in graph.nearest_mainline(got).collect()}
    assert near["73"] == "m6" and near["70"] == "m3"
