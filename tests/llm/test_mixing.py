import os
import random

import pytest

from commitloom.llm.mixing import mix, plan, shares
from commitloom.llm.tokens import VOCABULARY, count_tokens, encoding, pieces

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, sizes):
    rows, i = [], 0
    for source, (n, words) in sizes.items():
        for k in range(n):
            rows.append((i, source, " ".join(["word"] * (words + k % 5)), 1))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, copies int")


def test_shares_and_repeats(spark):
    docs = documents(spark, {"big": (1500, 40), "small": (60, 30), "tiny": (5, 20), None: (7, 10), "unasked": (10, 10)})
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 4), ("tiny", 0.05, 10), ("absent", 0.1, 2), (None, 0.1, 1)], TARGETS)
    mixed = mix(docs, targets).cache()
    got = {r.source: r for r in shares(mixed, targets).collect()}
    limits = {"big": 1, "small": 4, "tiny": 10}
    assert all(r.copies <= limits[r.source] for r in mixed.collect())
    total = sum(r.tokens for r in got.values())
    for s, share in (("big", 0.7), ("small", 0.25), ("tiny", 0.05)):
        assert abs(got[s].tokens / total - share) < 0.01
    assert got["absent"].tokens == 0
    again = mix(docs.repartition(7), targets)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in mixed.collect()}
    assert {tuple(r) for r in mix(docs, targets, seed=5).collect()} != {tuple(r) for r in mixed.collect()}


def test_given_total_and_weights(spark):
    docs = documents(spark, {"a": (400, 20)})
    targets = spark.createDataFrame([("a", 1.0, 3)], TARGETS)
    small = mix(docs, targets, total_tokens=1000).collect()
    assert abs(sum(r.n_tokens * r.copies for r in small) - 1000) <= 15
    huge = mix(docs, targets, total_tokens=10**9).collect()
    assert {r.copies for r in huge} == {3} and len(huge) == 400
    from pyspark.sql import functions as F

    heavy = docs.withColumn("w", F.when(F.col("doc_id") < 40, 9.0).when(F.col("doc_id") < 60, None).otherwise(1.0))
    drawn = mix(heavy, targets, total_tokens=2000, weight_col="w").collect()
    assert sum(r.doc_id < 40 for r in drawn) > 20 and not any(40 <= r.doc_id < 60 for r in drawn)


def test_empty_and_odd(spark):
    docs = spark.createDataFrame([(1, "a", None, 1), (2, "a", "", 1), (3, None, "x", 1), (4, "a", "one two", 1), (4, "a", "one two", 1), (None, "a", "x", 1)], "doc_id bigint, source string, text string, copies int")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert sorted(r.doc_id for r in mix(docs, targets).collect()) == [4]
    assert mix(docs.limit(0), targets).count() == 0 == mix(docs, targets.limit(0)).count()
    assert plan(docs.selectExpr("source", "0L as n_tokens"), targets).first().wanted == 0


def test_counting(spark):
    text = "Hello wörld, 你好! " * 3
    n = count_tokens(spark.createDataFrame([(1, text), (2, None)], "i int, text string"), ["i"]).collect()
    assert {r.i: r.n_tokens for r in n} == {1: len(encoding(VOCABULARY).encode_ordinary(text)), 2: 0}
    long = "ab cd\n" * 100_000
    assert "".join(pieces(long)) == long and max(map(len, pieces(long))) <= 200_000


def test_parts_have_the_tokens_of_the_whole(monkeypatch):
    from commitloom.llm import tokens

    enc = tokens.encoding(tokens.VOCABULARY)
    rng = random.Random(8)
    monkeypatch.setattr(tokens, "PIECE", 40)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "\t", " ", "x1", "...", "日本", "'s", "é", " \n"]) for _ in range(200))
        parts = tokens.pieces(text)
        assert "".join(parts) == text and len(parts) > 3
        assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
    assert tokens.pieces("a" * 500) == ["a" * 500]
