import pytest
from pyspark.sql import functions as F

from commitloom.functions import parsing as P

FIXES = [
    "fixed bug #1185609", "Closes-bug: 1250158", "Closes-Bug: #1300546", "Partial-bug: #1277104", "Fixes bug 1074132.", "Fixes LP Bug#879136 - keyerror", "Fixes: bug #1175815",
    "This is a continuous fix to bug #1166957", "This change fixes bug #1010560.", "Bug #930543", "Addresses bug 1154606.", "Resolves bug 1030396.", "Fixing bug 794582 - Now able to stream http(s) images",
    "check connection in Listener. refer to Bug #943031", "  * Bug 955475", "LP Bug#912800 - Delete image remain in cache", "Fixes bug 1059634. Related to I6cff4ee7", "Backport for bug 803055", "This addresses bug 767344.",
]
MENTIONS = [
    "Related-Bug: 1367908", "launchpad bug https://bugs.example.net/oslo/+bug/1158807.", "side effect it tests for the problem found in bug: 1068051", "currently impossible due to bug 1042925.", "depends on bug 1214830",
    "Prevent regression on bug 888370", "pipes@serialcoder:~/repos/x/bug730213$ ./run_tests.sh -V test", "",
]


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_bug_ids(spark):
    assert all(len(x) >= 1 for x in values(spark, FIXES, P.bug_ids))
    assert values(spark, ["Fixes bug 1008874, bug 1046433."], P.bug_ids) == [["1008874", "1046433"]]
    assert all(x == [] for x in values(spark, MENTIONS, P.bug_ids))
    assert values(spark, [None], P.bug_ids) == [None]


def test_change_id(spark):
    i = "I8fa8c4f36892b96d406216cb3c64854a94ca9df7"
    j = "I" + "0" * 40
    assert values(spark, [f"Change-Id: {i}", f"x\nChange-Id: {i}\nchange-id: {j}", f"see Change-Id: {i}", None], P.change_id) == [i, j, None, None]


def test_blueprint(spark):
    texts = ["bp:pci-passthrough-base", "bp: pci-passthrough-base", "blueprint:pci-passthrough-base", "Blueprint: pci-passthrough-base.", "booprint:pci-passthrough-base", "see https://blueprints.example.net/x/+spec/pci-passthrough-base\nblueprint"]
    assert values(spark, texts, lambda c: P.blueprint(c)) == ["pci-passthrough-base"] * 4 + [None, "pci-passthrough-base"]
    assert values(spark, ["blueprint https://blueprints.example.net/+spec/abc"], lambda c: P.blueprint(c)) == ["abc"]


@pytest.mark.parametrize(("actor", "name", "email", "org"), [('<git.Actor "A B <a@b.c>">', "A B", "a@b.c", "b.c"), ('<git.Actor " <>">', "", "", None), ("odd", None, None, None), ('<git.Actor "x@y.z <none>">', "x@y.z", "none", "y.z")])
def test_actor(spark, actor, name, email, org):
    assert values(spark, [actor], P.actor_name) == [name] and values(spark, [actor], P.actor_email) == [email] and values(spark, [actor], P.author_org) == [org]


def test_file_filter(spark):
    paths = ["a/b.py", "tools/b.py", "a/b.txt", "x.go"]
    assert values(spark, paths, lambda c: P.analysed_file(c)) == [True, False, False, True]


def test_policies(spark):
    df = spark.range(1)
    got = df.select(*[P.policy_weight(F.lit(3), p).alias(p) for p in ("flat", "linear", "strong_exp", "weak_exp")]).first()
    assert list(got) == [1.0, 3.0, 4.0, 2.0]


def test_tracker_links(spark):
    url = "Committed: https://git.example/"
    texts = [f"Reviewed\nChange-Id: Iabc\n{url}x/commit/?id=123", f"{url}y/77", "Change-Id: Iabc", None]
    got = values(spark, texts, lambda c: P.tracker_links(c, [url]))
    assert got[0].asDict() == {"change_id": "Iabc", "cid": "123"} and got[1:] == [None, None, None]
