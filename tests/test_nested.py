import json

from hypothesis import given
from hypothesis import strategies as st

from talkmill.functions.jsonstream import compact, plan_of, read_records
from talkmill.operators.nested import FlatTable, flatten, table_of

NODES = FlatTable("nodes", "$.mapping.*", {"parent": "parent", "title": "$.title", "kind": "parent#type"})
PARTS = FlatTable("parts", "$.mapping.*.parts[]", {"value": "", "type": "#type", "text": "text", "parent": "$.mapping.*.parent"})
VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "m", "é\"\\"]), x, max_size=3), max_leaves=12)


def walk(value, path, place, wanted):
    """Brute force: every wanted value of a parsed record."""
    if path in wanted:
        yield path, place, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.*", (*place, k), wanted) if f"{path}.*" in wanted else walk(v, f"{path}.{k}", place, wanted)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[]", (*place, i), wanted)


@given(VALUES, st.booleans())
def test_the_stream_gives_what_a_tree_gives(value, spaced):
    wanted = frozenset(["$", "$.a", "$.a[]", "$.a[].b", "$.a.b", "$.b[][]", "$.m.*", "$.m.*.a", "$.m.*[].b"])
    text = json.dumps(value, indent=1 if spaced else None, ensure_ascii=spaced)
    got = [(n, p, o, json.loads(v.text[v.begin : v.end]), v.kind) for n, found in read_records(text, plan_of(wanted)) for p, at in found.items() for o, v in at.items()]
    records = enumerate(value) if isinstance(value, list) else [(0, value)]
    want = [(n, p, o, v) for n, one in records if isinstance(one, dict) for p, o, v in walk(one, "$", (), wanted)]
    assert sorted(map(repr, (x[:4] for x in got))) == sorted(map(repr, want))
    assert json.loads(compact(text)) == value and compact(text) == json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)


@given(VALUES, st.integers(0, 200), st.sampled_from(["", ",", "}", "]", '"', "x", ":", "{", "[", "1"]))
def test_only_valid_json_holds_something(value, at, change):
    text = json.dumps({"a": value})
    text = text[:at] + change + text[at + 1 :]
    try:
        valid = json.loads(text, parse_constant=lambda c: 1 / 0) is not None
    except (ValueError, ZeroDivisionError):
        valid = False
    if not valid:
        assert compact(text) is None and read_records(text, plan_of(frozenset(["$"]))) == []
    else:
        assert compact(text) is not None


def test_strict_json_and_any_depth():
    plan = plan_of(frozenset(["$", "$.a"]))
    for text in ("NaN", '{"a": 1', "", None, '{"a": 01}', '{"a": 1,}', "[1 2]", '{"a" 1}', '{"a": "\n"}', "{} {}"):
        assert read_records(text, plan) == []
    deep = '{"x": ' + "[" * 300_000 + "]" * 300_000 + ', "a": "kept"}'
    assert str(read_records(deep, plan)[0][1]["$.a"][()]) == "kept"
    assert str(read_records('{"a": 1, "a": "last"}', plan)[0][1]["$.a"][()]) == "last"
    assert str(read_records(r'{"a": "\ud800x"}', plan)[0][1]["$.a"][()]) == "�x"


def test_a_repeated_key_counts_last_with_what_is_below():
    plan = plan_of(frozenset(["$.m.*", "$.m.*.p[]"]))
    [(_, found)] = read_records('{"m": {"k": {"p": [1, 2]}, "l": {"p": [3]}, "k": {"p": [4]}}}', plan)
    assert {o: str(v) for o, v in found["$.m.*.p[]"].items()} == {("l", 0): "3", ("k", 0): "4"}


def test_tables_name_their_parents(spark, rows):
    record = {"title": "t", "mapping": {"x.y": {"parent": None, "parts": ["a", {"text": "b"}, None]}, "z": {"parent": "x.y", "parts": []}}}
    df = rows([(1, json.dumps(record), "clash"), (1, json.dumps(record), "clash"), (2, json.dumps([record]), None), (3, "{", None), (4, None, None), (5, "", None), (6, "[]", None), (7, "3", None)], "id int, payload string, ordinals string")
    flat = flatten(df, "payload", ["id"], [NODES, PARTS])
    nodes = table_of(flat, NODES, ["id"]).collect()
    assert len(nodes) == 6 and {r["id"] for r in nodes} == {1, 2}
    assert {(r["ordinals"][0], r["parent"], r["kind"]) for r in nodes} == {("x.y", None, "null"), ("z", "x.y", "string")}
    parts = table_of(flat, PARTS, ["id"]).where("id = 2").collect()
    assert [(r["value"], r["type"], r["text"]) for r in parts] == [("a", "string", None), ('{"text": "b"}', "object", "b"), (None, "null", None)]
    assert {r["parent_key"] for r in parts} <= {r["row_key"] for r in nodes}


def test_empty_table_and_long_or_deep_records(spark, rows):
    assert flatten(rows([], "id int, payload string"), "payload", ["id"], [NODES]).count() == 0
    big = json.dumps({"title": "x" * 2_000_000, "mapping": {"k": {"parts": ["y" * 100_000]}}})
    deep = '{"mapping": {"k": {"other": ' + '{"x": ' * 20_000 + "1" + "}" * 20_000 + ', "parts": ["kept"]}}}'
    flat = flatten(rows([(1, big), (2, deep)], "id int, payload string"), "payload", ["id"], [PARTS])
    assert {r["id"]: len(r["value"]) for r in table_of(flat, PARTS, ["id"]).collect()} == {1: 100_000, 2: 4}
