import datetime as dt

import pytest

from commitloom.operators.orphans import canonical_bug, canonical_change, canonical_commit, orphan_report, repository_orphans

H = "0123456789abcdef0123456789abcdef0123456{:x}"
A, B, C, D = (H.format(i) for i in range(10, 14))
I1, I2, I3 = ("I" + H.format(i) for i in range(1, 4))
COMMITS = "cid string, change_id string, bugs array<string>, ingested_at timestamp_ntz, tombstone boolean, target string, dead int"
CHANGES = "change_id string, _number int, ingested_at timestamp_ntz, tombstone boolean"
BUGS = "id string, commits array<struct<change_id:string,cid:string>>, ingested_at timestamp_ntz, tombstone boolean, seen int"


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def tables(spark):
    commits = [
        (A, I1, ["1", "#2", " ", None, "lp:3"], day(1), None, "x", 1),
        (A, I1, ["1", "#2"], day(1), None, "x", 1),  # a copy
        (A, f" {I1.upper()}\n", ["9"], day(5), None, None, None),  # later row, written otherwise
        (B, I2, None, day(2), False, None, None),
        (C, I3, ["77"], day(2), None, None, None),
        (C, None, None, day(3), True, None, None),  # deleted: its references do not count
        (D, "", [], day(2), None, None, None),
    ]
    changes = [(I1, 1, day(0), None), (I1, 2, day(9), None), (I2, 3, day(0), None), (I2, 3, day(4), True), (I2, 4, day(1), True)]
    bugs = [
        ("1", [(I1, A[:9]), (None, f"https://git.example/c?id={B}"), None], day(0), None, 1),
        ("2", None, day(3), None, 1),
        ("3", [("nonsense", "fff0000000"), (I3, C)], day(0), None, 1),
    ]
    return spark.createDataFrame(commits, COMMITS), spark.createDataFrame(changes, CHANGES), spark.createDataFrame(bugs, BUGS)


def test_reasons(tables):
    got = {(r.src_table, r.src_key, r.ref_field, r.ref_value, r.reason) for r in repository_orphans(*tables).collect()}
    assert got == {
        ("commits", A, "bugs", "#2", "late"),
        ("commits", A, "bugs", "9", "missing"),
        ("commits", B, "change_id", I2, "deleted"),
        ("bugs", "3", "commits.change_id", "nonsense", "missing"),
        ("bugs", "3", "commits.change_id", I3, "missing"),
        ("bugs", "3", "commits.cid", "fff0000000", "missing"),
        ("bugs", "3", "commits.cid", C, "deleted"),
    } | {("bugs", "1", "commits.cid", A[:9], "late"), ("bugs", "1", "commits.cid", f"https://git.example/c?id={B}", "late")}


def test_report_sums_up(tables):
    found = repository_orphans(*tables)
    assert sum(r.orphans for r in orphan_report(found).collect()) == found.count()


def test_empty_tables(tables):
    c, h, b = tables
    assert repository_orphans(c.limit(0), h, b.limit(0)).count() == 0
    assert {r.reason for r in repository_orphans(c, h.limit(0), b).filter("ref_field = 'change_id'").collect()} == {"missing"}


def test_canonical_forms(spark):
    df = spark.createDataFrame([(f"x {I1.upper()}.", " lp:007. ", f"HTTP://h/?id={A.upper()}"), ("I123", "none", "abc"), (None, None, None)], "a string, b string, c string")
    rows = df.select(canonical_change(df.a), canonical_bug(df.b), canonical_commit(df.c)).collect()
    assert [tuple(r) for r in rows] == [(I1, "7", A), (None, None, None), (None, None, None)]
