import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from commitloom.llm import leakage as L

ITEM = "State whether the coarse pulley outlives the amber spindle once load_session has run 488 times. Every glib tenant owns a girder, and its armature tallies whatever the muted ingot left behind. Between 889 and 116 rounds, no jagged pulley ever hoists its hopper."
OTHER = "State whether the dense anvil outlives the frugal easel once bind_route has run 12 times. Every keen tenant owns a trellis, and its quoin filters whatever the narrow joist left behind. Between 3 and 99 rounds, no inert kiln ever yokes its winch."


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcde", min_size=L.GRAM + L.WINDOW - 1, max_size=60), st.text(alphabet="abcde", max_size=40), st.text(alphabet="abcde", max_size=40))
def test_every_long_shared_span_has_a_fingerprint(span, before, after):
    item = L.gram_hashes([span])
    assert np.isin(L.winnow(L.gram_hashes([before + span + after])), item).any()


def item(text):
    words = L.words(text)
    return L.Item(words, [1.0] * len(words))


def part(text, of):
    return L.carried(L.words(text), of)[0]


def test_what_is_carried():
    wanted = item(ITEM)
    half = ITEM[: len(ITEM) // 2]
    assert L.carried(L.words(f"x y {ITEM} z"), wanted) == (1.0, 1.0)
    assert 0.45 < part(half, wanted) < 0.55
    assert part(half.upper().replace(" ", "\u00a0 "), wanted) > 0.45
    changed = half.replace("the amber", "this amber").replace("girder", "gridder")
    assert 0.4 < part(changed, wanted) < 0.52
    two = ITEM[:80] + ". Unrelated words stand here in between and go on for a while. " + ITEM[130:200]
    assert part(two, wanted) > 0.45
    assert part(OTHER, wanted) < 0.3
    shuffled = L.words(ITEM)
    random.Random(1).shuffle(shuffled)
    assert L.carried(shuffled, wanted)[0] < 0.2
    assert L.carried([], wanted) == (0.0, 0.0) == L.carried(L.words(ITEM), item(""))


def test_short_items_that_stand_whole(spark):
    texts = ["Five words make an item", "Unguent hoists quoin", "Gyroscopes oscillate", "Nine"]
    items = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "item_id bigint, suite string, item_text string")
    filler = "Nothing of the kind stands in these many other lines of text. " * 3
    documents = spark.createDataFrame([(i, f"{filler}{t}, he said. {filler}") for i, t in enumerate(texts)] + [(9, filler)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(documents, items).collect()} == {(0, 0), (1, 1), (2, 2)}  # the last one is shorter than a fingerprint


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.text(alphabet="abcdefg ", max_size=60))
def test_one_common_span_makes_a_candidate(start, around):
    folded = "".join(L.words(ITEM))
    span = folded[start : start + L.GRAM + L.WINDOW - 1]
    block = L.Block([(7, L.words(ITEM), [1.0] * len(L.words(ITEM)))])
    assert block.candidates(L.gram_hashes([around.replace(" ", "") + span + around.replace(" ", "")])) == [0]


def test_operator_in_one_block_and_in_many(spark):
    docs = [(1, f"Intro. {ITEM}", 1), (2, OTHER, 1), (3, None, 1), (4, "", 1), (5, f"> {ITEM[:150]}\n> end", 1), (6, f"Intro. {ITEM}", 1), (1, f"Intro. {ITEM}", 1), (7, "filler " * 50_000 + ITEM, 1), (None, ITEM, 1)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, h int")
    items = spark.createDataFrame([(10, "s", ITEM), (11, "s", None), (12, "s", "tiny"), (None, "s", ITEM), (13, "s", "Let us see whether the kiln yokes its hopper before the winch is sealed.")], "item_id bigint, suite string, item_text string")
    want = {(1, 10), (5, 10), (6, 10), (7, 10)}
    for most in (L.BLOCK_CHARS, 1):
        assert {(r.doc_id, r.item_id) for r in L.leaks(documents, items, block_chars=most).collect()} == want
    assert L.leaks(documents.limit(0), items).count() == 0 == L.leaks(documents, items.limit(0)).count()
    report = L.leak_report(L.leaks(documents, items), items).collect()
    assert [(r.item_id, r.documents) for r in report] == [(10, 4)]


def test_copies_of_an_item_are_all_found(spark):
    text = "State whether the coarse pulley outlives the amber spindle once load_session has run 488 times. Every glib tenant owns a girder, and its armature tallies whatever the muted ingot left behind."
    items = spark.createDataFrame([(i, "s", text) for i in range(6)] + [(9, "s", "Between 889 and 116 rounds, no jagged kiln ever hoists its hopper, nor yokes its winch.")], "item_id bigint, suite string, item_text string")
    documents = spark.createDataFrame([(1, f"Intro. {text} End."), (2, "Nothing of the kind stands here, whatever one may look for.")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(documents, items).collect()} == {(1, i) for i in range(6)}


def test_versions_of_an_item_are_all_found(spark):
    items = spark.createDataFrame([(i, "s", f"{ITEM} Version {i} of it.") for i in range(8)], "item_id bigint, suite string, item_text string")
    documents = spark.createDataFrame([(1, f"Intro. {ITEM} End.")], "doc_id bigint, text string")
    assert {r.item_id for r in L.leaks(documents, items).collect()} == set(range(8))


def test_stock_of_many_items_proves_nothing(spark):
    stock = "Attach the output of the diagnostic command and describe the steps that lead to the problem."
    own = "the talk about {} pulleys begins with armatures, girders outlive {} spindles and no joist yokes its winch".format
    items = spark.createDataFrame([(i, "s", f"{stock} Item {i}: {w} is what " + own(w, w[::-1])) for i, w in enumerate("alpha beta gamma delta epsilon zeta eta".split())], "item_id bigint, suite string, item_text string")
    others = [(i, "s", f"{stock} {w} {w}er {w}ing un{w} {w}ly {w}ness {w}s re{w} {w}ful {w}less {w}ish mis{w}") for i, w in enumerate("kiln easel quoin gavel lathe niche oculus".split(), 20)]
    items = items.unionAll(spark.createDataFrame(others, items.schema))
    documents = spark.createDataFrame([(1, f"Please read this. {stock} Thank you."), (2, others[0][2])], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(documents, items.filter("item_id >= 20")).collect()} == {(2, 20)}


def test_like_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    texts = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(300)]
    docs = []
    for d in range(120):
        own = texts[rng.randrange(300)]
        a = rng.randrange(20)
        part_ = own[a : a + rng.choice([6, 12, 18, 24])]
        docs.append((d, " ".join([*[rng.choice(vocabulary) for _ in range(20)], *part_, *[rng.choice(vocabulary) for _ in range(20)]])))
    items = spark.createDataFrame([(i, "s", " ".join(t)) for i, t in enumerate(texts)], "item_id bigint, suite string, item_text string")
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(documents, items, block_chars=20_000).collect()}
    rarity = {r.word: r.n for r in items.selectExpr("item_id", "explode(array_distinct(split(item_text, ' '))) AS word").groupBy("word").agg({"item_id": "count"}).toDF("word", "n").collect()}
    want = set()
    for i, t in enumerate(texts):
        one = L.Item(t, [float(np.log(1 + 300 / rarity[w])) for w in t])
        for d, text in docs:
            share, own_ = L.carried(text.split(), one)
            if share >= L.SHARE and own_ >= L.OWN:
                want.add((d, i))
    assert got == want and len(want) > 30
