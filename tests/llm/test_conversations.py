import json
import random
from datetime import datetime

import pytest

from talkmill.llm import conversations as cv

OC = "msg_row bigint, message_id string, session_id string, role string, parts array<struct<type: string, text: string>>, content string, time_created bigint, parent_id string, kept string"


def oc(row, session, key, role="user", text="x", at=None, parent=None):
    return (row, key, session, role, [{"type": "text", "text": text}], None, row if at is None else at, parent, None)


def kept(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["session_key"], r["pos"])):
        out.setdefault(r["session_key"], []).append(r["msg_key"])
    return out


def test_kahn():
    order, left = cv.kahn({"a": None, "b": "a", "c": "a", "d": "c"}, {"a": 1, "b": 5, "c": 2, "d": 9})
    assert order == ["a", "c", "b", "d"] and not left
    assert cv.kahn({"a": "b", "b": "a", "c": None, "d": "zz"}, {})[1] == {"a", "b", "d"}
    assert cv.kahn({}, {}) == ([], set()) and cv.kahn({"x": "x"}, {})[1] == {"x"}
    assert not cv.alternates(["user", "user"]) and cv.alternates([]) and cv.complete(["user", "assistant"])


def test_rows(spark, rows):
    data = [
        oc(1, "ok", "m1", " Human"), oc(2, "ok", "m2", "AI", parent="m1"), oc(9, "ok", "m2", "AI", at=2, parent="m1"), oc(3, "ok", "m3", "tool"), oc(4, "ok", "m4", "user", text=" \n"), oc(2, "ok", "m1b", "model"),
        oc(1, "nouser", "a", "assistant"), oc(1, "unanswered", "a"), oc(1, "badrole", "a", "?"), oc(2, "badrole", "b", "ai"), oc(1, "norole", "a", None), oc(2, "norole", "b", "ai"), oc(1, "lost", "a", parent="zz"), oc(2, "lost", "b", "ai"),
        oc(1, None, "a"), oc(1, "noid", None), oc(2, "noid", "b", "ai"), (1, "t", "notime", "user", None, "text", None, None, None), oc(2, "notime", "u", "ai"),
        (1, "c1", "content", "user", [{"type": "text", "text": "x"}], "", 1, None, None), (2, "c2", "content", "user", None, "hi", 2, None, None), (3, "c3", "content", "model", [{"type": "reasoning", "text": "x"}, {"type": "text", "text": None}, {"type": "text", "text": "y"}], None, 3, None, None),
    ]
    df = rows(data, OC)
    df = df.unionByName(rows([oc(1, "ring", "r1", parent="r2"), oc(2, "ring", "r2", "ai", parent="r1")], OC))
    for limit in (100_000, 1):
        assert kept(cv.rebuild(cv.from_rows(df), limit)) == {"ok": ["m1", "m1b", "m2"], "content": ["c2", "c3"]}
    assert cv.rebuild(cv.from_rows(df.limit(0))).count() == 0


def node(role, text, parent, **more):
    return {"parent": parent, "message": {"author": {"role": role}, "content": {"parts": [text]}}} | more


def test_mappings(spark, rows):
    good = {"conversation_id": "c", "current_node": "b", "mapping": {"r": {"parent": None, "message": None}, "a": node("user", "q", "r"), "b": node("assistant", {"text": "a"}, "a"), "s": node("user", "side", "a")}}
    circle = {"id": "circle", "current_node": "b", "mapping": {"a": node("user", "q", "b"), "b": node("assistant", "a", "a")}}
    lost = {"id": "lost", "current_node": "b", "mapping": {"a": node("user", "q", "zz"), "b": node("assistant", "a", "a")}}
    away = {"id": "away", "current_node": "q", "mapping": {"a": node("user", "q", None)}}
    newer = {"conversation_id": "re", "current_node": None, "mapping": {}}
    older = {"conversation_id": "re"} | {k: good[k] for k in ("current_node", "mapping")}
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    data = [(1, json.dumps([good]), t[0]), (2, json.dumps(circle), t[0]), (3, json.dumps(lost), t[0]), (4, json.dumps(away), t[0]), (5, json.dumps(older), t[0]), (6, json.dumps(newer), t[1]), (7, json.dumps(newer)[:9], t[2]), (8, None, t[0]), (9, "[]", None), (10, json.dumps({"mapping": 3, "id": "odd", "current_node": "x"}), None)]
    df = rows(data, "rec_id bigint, payload string, received_at timestamp").selectExpr("*", "'x' AS session_key", "0 AS pos")
    assert kept(cv.from_mappings(df)) == {"c": ["a", "b"]}
    assert kept(cv.from_mappings(df.where("rec_id <> 6"))) == {"c": ["a", "b"], "re": ["a", "b"]}
    assert cv.from_mappings(df.limit(0)).count() == 0


def line(kind, uuid, parent, text="x", session="s", **more):
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "message": {"role": kind, "content": text}} | ({"sessionId": session} if session else {}) | more


def lines(rows, files):
    data = [(f, i, None, x if isinstance(x, str) or x is None else json.dumps(x)) for f, content in files.items() for i, x in enumerate(content)]
    return rows(data + data[:1], "source_path string, line_no int, device string, payload string")


@pytest.mark.parametrize("limit", [100_000, 1])
def test_lines(spark, rows, limit):
    files = {
        "f1": [{"type": "summary"}, line("user", "u1", None), line("assistant", "a1", "u1", [{"type": "text", "text": "t"}], None), line("user", "side", "u1", isSidechain=True), line("user", "blank", "a1", [{"type": "tool_result", "content": "x"}])],
        "f2": [line("assistant", "a2", "blank"), line("user", "u1", None)],
        "bad": [line("user", "u", None, session="bad"), "{", line("assistant", "a", "u", session="bad")], "bad2": [line("user", "x", None, session="bad")],
        "circle": [line("user", "u", None, session="circle"), line("assistant", "a", "b", session="circle"), line("assistant", "b", "a", session="circle")],
        "lost": [line("user", "u", None, session="lost"), line("assistant", "a", "zz", session="lost")], "toside": [line("user", "u", None, session="ts", isSidechain=True), line("assistant", "a", "u", session="ts")],
        "none": [line("user", "u", None, session=None), line("assistant", "a", "u", session=None)], "unanswered": [line("user", "u", None, session="un")], "nouuid": [line("user", None, None, session="nu"), line("assistant", "a", None, session="nu")],
    }
    zones = rows([("d", "UTC")], "device string, zone string")
    assert kept(cv.rebuild(cv.from_lines(lines(rows, files), zones), limit)) == {"s": ["u1", "a1", "a2"]}
    assert cv.rebuild(cv.from_lines(lines(rows, files).limit(0), zones)).count() == 0


def test_report(spark, rows):
    turns = rows([("oc", "a", 0, "x", "user"), ("oc", "a", 1, "y", "assistant"), ("oc", "b", 0, "x", "user"), ("oc", "b", 1, "z", "user"), ("oc", "b", 2, "y", "assistant")], cv.TURNS)
    assert [tuple(r) for r in cv.report(turns).collect()] == [("oc", 2, 5, 1)]


def test_large_graphs_are_ordered_alike(spark, rows):
    rng = random.Random(4)
    data = []
    for s in range(4):
        n = 200
        for i in range(n):
            parent = None if i == 0 else f"n{rng.randrange(max(0, i - 5), i):03}"
            data.append((f"s{s}", f"n{i:03}", parent, rng.choice([None, rng.randrange(50)]), "user" if i % 2 == 0 else "assistant", True))
        data.append((f"s{s}", "zend", "n199", 10**9, "assistant", True))
    data += [("cyc", "a", "b", 1, "user", True), ("cyc", "b", "a", 1, "assistant", True), ("cyc", "r", None, 1, "user", True)]
    df = rows(data, "session_key string, msg_key string, parent string, time bigint, role string, said boolean").selectExpr("'jsonl' AS src", "*", "false AS bad")
    small, large = kept(cv.rebuild(df)), kept(cv.rebuild(df, graph_limit=1))
    assert small == large and "cyc" not in small
    for s, order in small.items():
        place = {k: i for i, k in enumerate(order)}
        assert all(place[p] < place[k] for ss, k, p, *_ in data if ss == s and p)
