import datetime as dt
import random

from pyspark.sql import functions as F

from commitloom.operators import authors, graph, guilt, joins, ordering, ranges
from commitloom.runtime import current_rows, fresh, undeleted

DIFF = "--- a/f.py\n+++ b/f.py\n@@ -10,6 +10,6 @@ def f():\n a\n b\n-c\n+C\n d\n e\n f\n@@ -40,3 +40,4 @@\n x\n y\n+new\n z\n@@ -0,0 +1 @@\n+only\n\\ No newline at end of file"


def test_diff_seeds_and_proximity(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "k int, diff_text string")
    lines = ranges.diff_lines(df, ["k"])
    assert {r.lineno for r in ranges.change_seeds(lines, ["k"]).collect()} == {12, 41, 42}
    near = {(r.lineno, r.proximity) for r in ranges.proximity(lines, ["k"], 3).collect()}
    assert near == {(10, 3), (11, 2), (12, 1), (13, 2), (14, 3), (40, 2), (41, 1), (42, 1)}
    loc = df.select(ranges.lines_of_code(F.col("diff_text")).alias("x")).first().x
    assert (loc["add"], loc["remove"], loc["change"]) == (3, 1, 3)


def test_proximity_of_many_diffs_broadcasts_nothing(spark, tmp_path):
    """By its columns in a file the input looks tiny; its lines, of which no plan knows, must not go through the driver."""
    rows = [(1, 5, DIFF), (1, 5, DIFF), (None, 5, DIFF), (2, 6, None), (2, 7, "@@ -1,2 +0,0 @@\n-a\n-b\n@@ -3 +1,2 @@\n x\n+y")]
    spark.createDataFrame(rows, "k int, n int, diff_text string").write.parquet(str(tmp_path / "diffs"))
    near = ranges.proximity(ranges.diff_lines(spark.read.parquet(str(tmp_path / "diffs")), ["k", "n"]), ["k", "n"], 3)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1
    mine = [(10, 3), (11, 2), (12, 1), (13, 2), (14, 3), (40, 2), (41, 1), (42, 1)]
    assert sorted((r.k or 0, r.n, r.lineno, r.proximity) for r in near.collect()) == [(k, 5, *x) for k in (0, 1) for x in mine] + [(2, 7, n, 1) for n in (1, 2, 3)]


def test_proximity_of_repeated_parts_is_that_of_sql(spark, tmp_path):
    import duckdb

    from commitloom.queries import ORACLE, QUERIES

    rows = [(1, 5), (1, 5), (2, 7), (3, 1), (3, 4), (None, 9), (None, 9), (4, None)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["diff_proximity"](spark, str(tmp_path)).collect()
    want = duckdb.sql(ORACLE["diff_proximity"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    assert len(want) == 35 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_runs_and_merged_ranges(spark):
    rows = spark.createDataFrame([(1, x) for x in (1, 2, 2, 3, 7, 9, 10)], "k int, lineno int")
    assert {(r.start, r.end) for r in ranges.line_runs(rows, ["k"]).collect()} == {(1, 3), (7, 7), (9, 10)}
    rng = random.Random(1)
    spans = [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 60) for _ in range(25))] + [(5, 40), (6, 7)]
    covered = {x for a, b in spans for x in range(a, b + 1)}
    got = ranges.merge_ranges(spark.createDataFrame([(1, *s) for s in spans], "k int, start int, end int"), ["k"]).collect()
    assert {x for r in got for x in range(r.start, r.end + 1)} == covered
    ends = sorted((r.start, r.end) for r in got)
    assert all(b[0] > a[1] + 1 for a, b in zip(ends, ends[1:]))


def test_guilt_properties(spark):
    rng = random.Random(3)
    blame = spark.createDataFrame([(rng.randint(1, 5), rng.choice("abc"), rng.randint(1, 4)) for _ in range(80)], "e int, c string, p int")
    shares = guilt.normalised(blame, ["e"], "c", guilt.proximity_weight(F.col("p")))
    assert all(abs(r.s - 1) < 1e-9 for r in shares.groupBy("e").agg(F.sum("guilt").alias("s")).collect())
    bugs = spark.createDataFrame([(e, i) for e in range(1, 6) for i in ("High", "Low")], "e int, importance string")
    raw = guilt.raw_by_severity(shares, bugs, ["e"], "c", ["High", "Low"])
    total = raw.agg(F.sum("guilt")).first()[0]
    assert abs(total - 10) < 1e-9
    grid = {(r.c, r.policy, r.level): r.total for r in guilt.total_grid(raw, "c", {"High": 3, "Low": 1}).collect()}
    for r in raw.collect():
        assert abs(grid[r.c, "flat", "low+"] - r.guilt) < 1e-9 and abs(grid[r.c, "linear", "high+"] - r.High) < 1e-9 and grid[r.c, "flat", "crit"] == 0


def test_dense_order_is_a_permutation(spark):
    df = spark.range(997).select((F.col("id") % 50).alias("date"), F.col("id").alias("cid"), F.lit(1).alias("_part"))
    got = [(r.date, r.cid, r.order) for r in ordering.dense_order(df, ["date", "cid"], slices=7).orderBy("order").collect()]
    assert [g[2] for g in got] == list(range(1, 998)) and got == sorted(got)


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    want = {x: min(v) for v in groups.values() for x in v}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_aliases(spark):
    rows = [("x1", "Ann", "a@x", 1), ("x2", "Ann", "b@x", 5), ("x3", "Bob", "B@x", 3), ("x4", "", "", 9), ("x5", None, None, 9), ("x6", " ", "c@x", 2)]
    got = {r.actor: r.standard_actor for r in graph.actor_aliases(spark.createDataFrame(rows, "actor string, name string, email string, at int")).collect()}
    assert got == {"x1": "x2", "x2": "x2", "x3": "x2", "x4": "x4", "x5": "x5", "x6": "x6"}


def test_walks_and_mainline(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("s", "b"), ("t", "s"), ("u", "v"), ("v", "u"), ("w", "gone")], "node string, parent string")
    stops = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {r.node: (r.stop, r.distance) for r in graph.walk_to(links, stops).collect()}
    assert got == {"a": ("a", 0), "b": ("b", 0), "c": ("c", 0), "s": ("b", 1), "t": ("b", 2), "u": (None, None), "v": (None, None), "w": (None, None)}
    line = {r.node: r.position for r in graph.mainline(links, spark.createDataFrame([("t",)], "node string")).collect()}
    assert line == {"t": 0, "s": 1, "b": 2, "a": 3}


def test_branch_closure_with_a_diamond(spark):
    edges = spark.createDataFrame([("m", "main"), ("m", "d4"), ("d4", "d2"), ("d4", "d3"), ("d2", "d1"), ("d3", "d1"), ("d1", "main")], "child string, parent string")
    got = {(r.node, r.depth) for r in graph.branch_closure(spark.createDataFrame([("m", "d4")], "merge string, node string"), edges, spark.createDataFrame([("m",), ("main",)], "node string")).collect()}
    assert got == {("d4", 1), ("d2", 2), ("d3", 2), ("d1", 3)}


def test_current_rows_edge_cases(spark):
    t = [dt.datetime(2020, 1, i) for i in range(1, 4)]
    df = spark.createDataFrame([("a", t[0], None, 1), ("a", t[1], None, 2), ("a", t[1], None, 2), ("b", t[0], False, 3), ("b", t[2], True, None), (None, t[0], None, 5), ("c", None, None, 6)], "k string, ingested_at timestamp_ntz, tombstone boolean, _rank int")
    assert {(r.k, r._rank) for r in undeleted(current_rows(df, ["k"])).collect()} == {("a", 2), (None, 5), ("c", 6)}
    assert current_rows(df.limit(0), ["k"]).count() == 0
    assert fresh(["x", "X_1"], "x") == "x_2"


def test_joins_and_trim(spark):
    prior = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new")], "id int, v string")
    assert {tuple(r) for r in joins.merge_prior_wins(prior, new, "id").collect()} == {(1, "old"), (2, "new")}
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"), F.lit(0).alias("_lo"))
    assert {r.v for r in authors.trim(df, "v").collect()} == set(map(float, range(2, 10)))
    hist = {(r.bin, r.n, r.running) for r in authors.histogram(df, "v", 5.0).collect()}
    assert hist == {(0, 4, 4), (1, 5, 9), (2, 1, 10)}
