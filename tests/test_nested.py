import json

from hypothesis import given, settings
from hypothesis import strategies as st

from commitloom.operators.nested import flatten_json, index_texts

FIELDS = ["labels", "messages"]


def brute(value, path, out):
    if isinstance(value, str):
        text = value.strip(" \t\r\n")
        if text[:1] not in ("{", "["):
            return
        try:
            value = json.loads(text, parse_constant=_no)
        except ValueError:
            return
    if isinstance(value, dict):
        if "/" in path:
            out.add(path)
        for k, v in value.items():
            brute(v, f"{path}/{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            brute(v, f"{path}/{i}", out)


def _no(x):
    raise ValueError(x)


def expected(text):
    try:
        top = json.loads(text, parse_constant=_no)
    except ValueError:
        return set()
    out = set()
    if isinstance(top, dict):
        for f in FIELDS:
            if f in top:
                brute(top[f], f, out)
    return out


def found(*texts):
    return {(r[0], r[1]) for r in index_texts([(t.encode(), i) for i, t in enumerate(texts)], FIELDS)}


leaf = st.none() | st.booleans() | st.integers() | st.text(alphabet='ab"\\{}[]:, \n/é', max_size=8)
keys = st.text(alphabet='ab"\\{c:é', min_size=1, max_size=4)
values = st.recursive(leaf, lambda x: st.lists(x, max_size=4) | st.dictionaries(keys, x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.fixed_dictionaries({}, optional={"labels": values, "messages": values, "other": values}), min_size=1, max_size=4), st.booleans(), st.booleans())
def test_like_a_parser(records, ascii_, cut):
    texts = [json.dumps(r, ensure_ascii=ascii_) for r in records]
    if cut:
        texts[0] = texts[0][:-1]
    assert found(*texts) == {(i, p) for i, t in enumerate(texts) for p in expected(t)}


def test_strings_of_json_at_any_level():
    inner = json.dumps([{"a": {"b": 1}}])
    text = json.dumps({"messages": inner, "labels": {"x": json.dumps({"messages": [{}]})}})
    assert found(text) == {(0, p) for p in expected(text)} >= {(0, "messages/0/a"), (0, "labels/x/messages/0")}


def test_broken_and_odd_texts():
    assert found("", " ", "null", "[]", "{", '{"labels": {"a": {}}', '{"labels": {"a": {}}} x', '{"labels": {"a": NaN, "b": {}}}', "\\", '"') == set()


def test_last_of_repeated_keys_counts():
    assert found('{"labels": {"a": {"x": {}}, "a": {"y": {}}}}') == {(0, "labels/a"), (0, "labels/a/y")}
    assert found('{"labels": {"a": {"x": {}}, "a": 1}}') == set()


def test_positions_count_nulls_and_empty_objects_are_rows():
    assert found('{"messages": [null, {}, {"comments": [null, {}]}]}') == {(0, "messages/1"), (0, "messages/2"), (0, "messages/2/comments/1")}


def test_very_long_text():
    text = json.dumps({"messages": [{"content": "x\\\"{" * 400_000, "a": {}}]})
    assert found(text) == {(0, "messages/0"), (0, "messages/0/a")}


def test_links_and_clashing_columns(spark):
    rows = [(1, '{"labels": {"V": {"all": [{"value": 1}, null, {"value": 2}]}}}', "p", 7), (None, '{"messages": [{}]}', None, None), (2, None, "q", 8), (1, '{"labels": {"V": {"all": [{"value": 1}, null, {"value": 2}]}}}', "p", 7)]
    df = spark.createDataFrame(rows, "k int, t string, parent_key string, pos int")
    out = [r.asDict() for r in flatten_json(df, "k", "t", FIELDS, with_json=True).collect()]
    assert len(out) == 7
    child = next(r for r in out if r["child_path"] == "labels/V/all/2")
    assert (child["parent_key"], child["parent_path"], child["pos"], child["name"], json.loads(child["json"])) == ("1", "labels/V", 2, None, {"value": 2})
    assert next(r for r in out if r["parent_key"] is None)["child_path"] == "messages/0"
    assert flatten_json(df.limit(0), "k", "t", FIELDS).count() == 0


def test_parent_across_a_string():
    text = json.dumps({"messages": [{"comments": json.dumps([{"replies": [{}]}])}]})
    rows = {r[1]: r[2] for r in index_texts([(text.encode(), 1)], FIELDS)}
    assert rows == {"messages/0": None, "messages/0/comments/0": "messages/0", "messages/0/comments/0/replies/0": "messages/0/comments/0"}


def test_depth_and_length_are_not_bounded(spark):
    depth = 20_000
    deep = '{"labels":' + '{"k":' * (depth - 1) + "{}" + "}" * depth
    long = '{"labels": {"a": {"value": ' + "9" * 6000 + "}}}"
    again = '{"messages": [{"x": 1}], "labels": {"k": {}, "k": {"v": {}}}, "messages": [null, {"y": 1.50}]}'
    rows = [(1, deep), (2, deep[:-1]), (3, long), (4, again), (5, '{"labels": {"a": {"value": NaN}}}')]
    got = flatten_json(spark.createDataFrame(rows[1:], "rec_no bigint, line string"), "rec_no", "line", ["labels", "messages"], with_json=True)
    plain = flatten_json(spark.createDataFrame(rows[:2], "rec_no bigint, line string"), "rec_no", "line", ["labels"])
    assert plain.groupBy("parent_key").count().collect() == [("1", depth - 1)]
    found = {(r.parent_key, r.child_path, r.json) for r in got.collect()}
    assert found == {("3", "labels/a", '{"value": ' + "9" * 6000 + "}"), ("4", "labels/k", '{"v": {}}'), ("4", "labels/k/v", "{}"), ("4", "messages/1", '{"y": 1.50}')}
