"""Completeness of JSON and repeated keys, against the standard library."""

import json
import random

from commitloom.functions import jsontext as J


def test_like_the_standard_library():
    rng = random.Random(3)
    toks = '{ } [ ] : , "a" "b" "a\\n" 1 -0.5e3 01 null true nul tru1 "'.split(" ")
    good = 0
    for _ in range(60_000):
        text = rng.choice(["", " "]).join(rng.choice(toks) for _ in range(rng.randint(1, 9)))
        try:
            value = json.loads(text)
        except ValueError:
            assert J._walk(text) is None and J.complete(text) is False
            continue
        good += 1
        assert J._walk(text) is not None and J.complete(text) is not False
        assert json.loads(J.last_of_keys(text)) == value
    assert good > 1000


def test_of_repeated_keys_the_last_counts():
    text = '{"a": {"x": 1, "x": 2}, "b" : [{"c": 1 , "c":2}], "a": {"y": {}}}'
    assert J.complete(text) is None
    assert J.complete(J.last_of_keys(text)) is True
    assert json.loads(J.last_of_keys(text)) == json.loads(text)


def test_any_depth_and_length():
    assert J.complete("[" * 100_000 + "]" * 100_000) is True
    assert J.complete("[" * 100_000 + "]" * 99_999) is False
    assert J.complete('{"k":' * 30_000 + "9" * 5000 + "}" * 30_000) is True
    assert J.complete('{"k": NaN}') is False and J.complete("") is False and J.complete(" \n") is False
