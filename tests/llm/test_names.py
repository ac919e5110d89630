import random
from itertools import combinations

import pytest

from commitloom.llm import names as N

from .test_pii import GIVEN, SURNAMES


def test_trie_join_finds_all_pairs(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 11))) for _ in range(300)}
    for w in list(words)[:120]:
        x = list(w)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(x))
            rng.choice([lambda: x.insert(i, "a"), lambda: x.pop(i) if len(x) > 1 else None, lambda: x.__setitem__(i, "b"), lambda: x.__setitem__(slice(i, i + 2), x[i : i + 2][::-1])])()
        words.add("".join(x))
    want = {(a, b, d) for a in words for b in words if a != b for d in [N.osa(a, b, 2)] if d <= min(N.edits_for(len(a)), N.edits_for(len(b)))}
    df = spark.createDataFrame([(w,) for w in [*words, "", None]], "token string")
    assert {tuple(r) for r in N.trie_join(df).collect()} == want


def test_hot_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    words = [f"prefix{a}{b}" for a in "abcdef" for b in "ghijkl"]
    got = {tuple(r) for r in N.trie_join(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b, N.osa(a, b, 2)) for a in words for b in words if a != b}


@pytest.mark.parametrize(
    ("name", "kind", "given", "surname"),
    [
        ("Anna Miller", "full", "anna", "miller"), ("Miller, Anna", "full", "anna", "miller"), ("Miller Anna", "full", "anna", "miller"), ("ANNA  MILLER", "full", "anna", "miller"), ("Bob Müller (Acme)", "full", "robert", "muller"),
        ('Robert "Bob" Müller', "full", "robert", "muller"), ("anna.miller", "full", "anna", "miller"), ("Anna B. Miller", "full", "anna", "miller"), ("A.B. Miller", "initial", "", "miller"), ("Miller, A.", "initial", "", "miller"),
        ("amiller", "initial", "", "miller"), ("Acme Technologies CI", "org", "org", "acme"), ("Acmetechnologies CI", "org", "org", "acme"), ("CI - Acme Tech.", "org", "org", "acme"), ("acme-ci", "org", "org", "acme"), ("Маргарет Валатастром", "full", "margaret", "valatastrom"), ("!!", "other", "", "!!"),
    ],
)
def test_readings(name, kind, given, surname):
    first = N.parse_name(name)[0]
    assert (first[0], first[1], first[3]) == (kind, given, surname)


def test_linking(spark):
    people = ["Anna Vodukarin", "Vodukarin, Anna", "anna vodukarin", "Ana Vodukarni", "A. Vodukarin", "avodukarin", "Anna Vodukarin (Acme)", "Thomas Vodukarin", "Tom Vodukarin", "Sunita Bremutalli", "Sunita Brekutolli", "Zorex CI", "Zorex Systems CI", "Zorex Continuous Integration", "Kipling Networks CI", "X", None, " "]
    names = spark.createDataFrame([(p, 20 if i in (0, 7, 9, 10) else 3) for i, p in enumerate(people)], "name string, n bigint")
    clues = spark.createDataFrame([("Sunita Bremutalli", "email", "sunita.bremutalli@x.y"), ("Sunita Brekutolli", "email", "sunita.brekutolli@x.y")], "name string, kind string, clue string")
    groups = {}
    for r in N.link_names(names, clues).collect():
        groups.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [set(people[:7]), {"Thomas Vodukarin", "Tom Vodukarin"}, {"Sunita Bremutalli"}, {"Sunita Brekutolli"}, set(people[11:14]), {"Kipling Networks CI"}, {"X"}]))
    pairs = {tuple(r) for r in N.spelling_pairs(N.link_names(names, clues)).collect()}
    assert ("Thomas Vodukarin", "Tom Vodukarin") in pairs and all(a < b for a, b in pairs) and len(pairs) == 21 + 1 + 3


def test_empty(spark):
    names = spark.createDataFrame([], "name string, n bigint")
    clues = spark.createDataFrame([], "name string, kind string, clue string")
    assert N.link_names(names, clues).count() == 0


def test_sources(spark):
    c = spark.createDataFrame([('<git.Actor "A "Al" B <a@b>">', 1), ('<git.Actor " <x>">', 1), (None, 1), ("odd", 1)], "committer string, name int")
    label = "struct<all:array<struct<_account_id:int,name:string,value:int>>,approved:struct<_account_id:int,name:string>,recommended:struct<_account_id:int,name:string>,value:int>"
    d = spark.createDataFrame([((1, "O"), {"V": ([(2, "P", 1), None, (None, "Q", 0)], (3, "R"), None, None), "W": None, "E": (None, None, (4, "S"), 1)}), (None, None)], f"owner struct<_account_id:int,name:string>, labels map<string,{label}>")
    names, clues = N.repository_names(c, d)
    assert {r.name for r in names.collect()} == {'A "Al" B', "O", "P", "Q", "R", "S"}
    assert {(r.name, r.kind, r.clue) for r in clues.collect()} == {('A "Al" B', "email", "a@b"), ("O", "account", "1"), ("P", "account", "2"), ("R", "account", "3"), ("S", "account", "4")}


def entities(spark, names, clues=()):
    df = spark.createDataFrame([(n, 1) for n in names], "name string, n bigint")
    known = spark.createDataFrame(list(clues), "name string, kind string, clue string")
    return {r.name: r.entity for r in N.link_names(df, known).collect()}


def test_names_outside_every_list(spark):
    same = [("Siobhan Gallagher", "Siobahn Gallagher"), ("Rajeshwari Iyer", "Rajeswari Iyer"), ("Fatima Hassan", "Fatma Hassan"), ("Chukwuemeka Obi", "Emeka Obi"), ("Q. Zimmerman", "Q. Zimerman")]
    other = [("Daniel Kim", "Danielle Kim"), ("Ada Kim", "Adam Kim"), ("Third Party CI", "Continuous Integration"), ("Bot Inc", "Company Ltd"), ("Smith", "Sam Mith"), ("Ngozi Obi", "Emeka Obi")]
    got = entities(spark, sorted({n for pair in same + other for n in pair}))
    assert [pair for pair in same if got[pair[0]] != got[pair[1]]] == []
    assert [pair for pair in other if got[pair[0]] == got[pair[1]]] == []


def test_two_given_names_that_many_people_have_are_two(spark):
    got = entities(spark, [f"Mirela {s}" for s in SURNAMES[:8]] + [f"Mirella {s}" for s in SURNAMES[7:15]])
    assert len(set(got.values())) == 16


def test_held_out_people(spark):
    rng = random.Random(12)
    people = [(GIVEN[i % 40], SURNAMES[(i * 7 + i // 40) % 40]) for i in range(240)]
    assert not any(N.skeleton(N.latin(g)) in N._GIVEN for g, _ in people)
    spelt = {}
    for n, (given, last) in enumerate(people):
        at = rng.randrange(1, len(last) - 1)
        forms = [f"{given} {last}", f"{given} {last[:at]}{last[at + 1:]}" if len(last) >= 7 else f"{given.upper()} {last.upper()}", f"{last}, {given}", f"{given} {rng.choice('BDFKT')}. {last}"]
        at = rng.randrange(2, len(given) - 1)
        forms.append(f"{given[:at]}{given[at + 1]}{given[at]}{given[at + 2:]} {last}" if len(given) >= 6 else f"{given.lower()} {last.lower()}")
        if sum(g[0] == given[0] and s == last for g, s in people) == 1:
            forms += [f"{given[0]}. {last}", f"{given[0]}{last}".lower().replace("'", "").replace("-", "")]
        for f in forms:
            spelt.setdefault(f, n)
    got = entities(spark, list(spelt))
    groups, truth = {}, {}
    for name, n in spelt.items():
        groups.setdefault(got[name], []).append(name)
        truth.setdefault(n, []).append(name)
    pairs = {p for v in groups.values() for p in combinations(sorted(v), 2)}
    wanted = {p for v in truth.values() for p in combinations(sorted(v), 2)}
    recall, precision = len(pairs & wanted) / len(wanted), len(pairs & wanted) / len(pairs)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, sorted(wanted - pairs)[:400:9])
