"""Totals and orders in ranges against plain ones, and blame of lines that a cache lacks."""

import random

from pyspark.sql import functions as F

from commitloom.ml.evaluate import kth_largest, sweep
from commitloom.operators.ordering import running_total
from commitloom.sources import git


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2, 3, None]), "x") for i in range(500)]
    rng.shuffle(rows)
    got = {r.k: r.total for r in running_total(spark.createDataFrame(rows, "k int, v int, _part string"), ["k"], "v", "total", 7).collect()}
    total = 0
    for k, v, _ in sorted(rows):
        total += v or 0
        assert got[k] == total
    assert running_total(spark.createDataFrame([], "k int, v int"), ["k"], "v").count() == 0


def test_kth_largest_and_sweep_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *[x / 16 for x in range(-4, 17)]]), rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "clf string, s double, y boolean")
    values = sorted((s for _, s, _ in rows if s and s > 0), reverse=True)
    for k in (1, 50, 10_000):
        assert kth_largest(df, "s", k).first().threshold == (values[k - 1] if k <= len(values) else values[-1])
    for r in sweep(df, ["clf"], "s", F.col("y"), -5, 40).collect():
        mine = [(s > r.threshold, y) for c, s, y in rows if c == r.clf and s is not None]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(sum(x == want for x in mine) for want in ((True, True), (True, False), (False, True), (False, False)))


def test_other_lines_of_a_cached_file_are_fetched(spark, monkeypatch):
    asked = []

    def blame(requests, repository):
        asked.extend(tuple(r) for r in requests.select("cid", "path", "start", "end").collect())
        return requests.select(F.col("cid").alias("at"), "path", F.lit("new").alias("cid"), F.explode(F.sequence("start", "end")).alias("lineno"), F.lit(None).cast("int").alias("orig_lineno"), F.lit("ok").alias("status"))

    monkeypatch.setattr(git, "blame", blame)
    cache = spark.createDataFrame([("c", "f", "old", n, n, "ok") for n in (3, 4, 5)] + [("c", "gone", None, None, None, "empty")], "at string, path string, cid string, lineno int, orig_lineno int, status string")
    requests = spark.createDataFrame([("c", "f", 2, 7), ("c", "f", 4, 5), ("c", "gone", 1, 2), ("d", "f", 1, 1)], "cid string, path string, start int, end int")
    got = {(r.at, r.path, r.lineno): r.cid for r in git.cached_blame(requests, "r", cache).collect()}
    assert sorted(asked) == [("c", "f", 2, 2), ("c", "f", 6, 7), ("d", "f", 1, 1)]
    assert got == {("c", "f", 2): "new", ("c", "f", 3): "old", ("c", "f", 4): "old", ("c", "f", 5): "old", ("c", "f", 6): "new", ("c", "f", 7): "new", ("c", "gone", None): None, ("d", "f", 1): "new"}


def test_percentiles_like_the_built_in_ones(spark):
    from commitloom.operators.authors import percentiles, trim

    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice([None, 1.5, 2.0, rng.random() * 9]),) for _ in range(333)], "x double")
    got = percentiles(df, "x", {"a": 0.01, "b": 0.5, "c": 0.99, "d": 1.0}).first()
    want = df.agg(*[F.percentile("x", F.lit(p)) for p in (0.01, 0.5, 0.99, 1.0)]).first()
    assert all(abs(g - w) < 1e-9 for g, w in zip(got, want))
    assert percentiles(df.limit(0), "x", {"a": 0.5}).first().a is None and trim(df.limit(0), "x").count() == 0


def test_of_one_batch_the_latest_row_of_a_key_is_added(spark, tmp_path):
    from commitloom.streaming import incremental

    rows = [(1, 5, "late"), (1, 2, "early"), (2, None, "none"), (2, 1, "one")]
    spark.createDataFrame(rows, "k int, at int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at int, v string").parquet(str(tmp_path / "in"))
    incremental.merge_new(stream, str(tmp_path / "out"), "k", str(tmp_path / "cp"), "at").awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "late"), (2, "one")}
