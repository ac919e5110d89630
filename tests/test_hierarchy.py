import datetime as dt
import random

import pytest

from commitloom.operators.hierarchy import commit_links, descendants, hierarchy, paths


def brute(links):
    out = {}
    for n in links:
        seen, x = [], n
        while x in links and links[x] in links and x not in seen:
            seen.append(x)
            x = links[x]
        if x in seen:
            out[n] = (min(seen[seen.index(x) :]), -1)
        else:
            out[n] = (x, len(seen))
    return out


def frame(spark, links):
    return spark.createDataFrame(list(links.items()), "node string, parent string")


def run(spark, links):
    return hierarchy(frame(spark, links))


@pytest.mark.parametrize("seed", range(4))
def test_random_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(60)]
    links = {n: rng.choice([*nodes, None, "gone", *nodes]) if seed % 2 else rng.choice([*nodes[:i], None]) for i, n in enumerate(nodes)}
    got = {r.node: (r.root, r.depth) for r in run(spark, links).collect()}
    assert got == brute(links)


def test_chain_paths_and_descendants(spark):
    links = {f"{i:03d}": f"{i - 1:03d}" if i else None for i in range(37)} | {"s": "s", "t": "s"}
    rows = {r.node: r for r in paths(frame(spark, links)).collect()}
    assert rows["036"].path == [f"{i:03d}" for i in range(37)] and rows["s"].path is None and rows["t"].depth == -1
    assert {r.node: r.root for r in run(spark, links).collect()}["t"] == "s"
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(frame(spark, links)).collect()}
    assert pairs == {(f"{a:03d}", f"{b:03d}", b - a) for b in range(37) for a in range(b)}


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_descendants_by_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:04d}" for i in range(400)]
    links = {n: rng.choice([nodes[i - 1], nodes[i - 1], nodes[i - 1], nodes[max(0, i - rng.randint(1, 9))], None if i % 150 == 0 else nodes[i - 1]]) if i else None for i, n in enumerate(nodes)}
    links |= {"r1": "r2", "r2": "r1", "below": "r1"}
    want = {}
    for n in links:
        path, x = [], n
        while x is not None and x not in path and len(path) < 500:
            path.insert(0, x)
            x = links[x]
        want[n] = path if x is None else None
    assert max(len(p) for p in want.values() if p) > 100
    df = frame(spark, links)
    assert {r.node: r.path for r in paths(df).collect()} == want
    pairs = sorted((r.ancestor, r.descendant, r.distance) for r in descendants(df).collect())
    assert pairs == sorted((a, n, len(p) - 1 - i) for n, p in want.items() if p for i, a in enumerate(p[:-1]))
    assert paths(df.limit(0)).count() == 0 == descendants(df.limit(0)).count()


def test_empty_repeated_and_star(spark):
    assert run(spark, {"a": None}).limit(0).count() == 0
    assert hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0
    star = spark.createDataFrame([("hub", "top"), ("top", None), *[(f"x{i}", "hub") for i in range(500)], ("x1", "hub"), (None, "hub")], "node string, parent string")
    got = hierarchy(star).collect()
    assert len(got) == 502 and {r.depth for r in got if r.node.startswith("x")} == {2}


def test_links_of_commits(spark):
    t = [dt.datetime(2020, 1, i) for i in range(1, 5)]
    rows = [("aa", ["bb"], t[0], None), ("aa", [" BB ", "x"], t[1], None), ("bb", [], t[0], None), ("cc", ["dd"], t[0], False), ("dd", None, t[0], None), ("dd", None, t[2], True), ("ee", [""], t[0], None), ("ff", None, t[0], None), ("gg", [None], t[0], None), ("aa", [" BB ", "x"], t[1], None)]
    df = spark.createDataFrame([(*r, "node") for r in rows], "cid string, parents array<string>, ingested_at timestamp_ntz, tombstone boolean, node string")
    assert {r.node: r.parent for r in commit_links(df).collect()} == {"aa": "bb", "bb": None, "cc": None, "ee": None, "ff": None, "gg": None}
