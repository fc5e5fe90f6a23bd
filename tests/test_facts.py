import json
from datetime import datetime

from pyspark.sql import functions as F

from talkmill.operators import entities as en
from talkmill.operators import facts as fa
from talkmill.schemas import FACTS

T0 = datetime(2024, 1, 1)


def fact(i, status="active", entities=(), by=None, project=None, provenance=(), category="fact", at=T0, statement="s"):
    return (i, statement, category, list(entities), 1.0, "user", [{"session_id": s, "chunk_id": None} for s in provenance], project, status, by, at, at)


def test_supersede_delete_backfill(spark):
    df = spark.createDataFrame([fact("a", by="b", status="superseded"), fact("b"), fact("c", provenance=["x", "s2", "s1"])], FACTS)
    now = F.lit("2025-01-01").cast("timestamp")
    done = {r["id"]: (r["status"], r["superseded_by"]) for r in fa.mark_superseded(df, spark.createDataFrame([("a", "z"), ("b", "c")], "id string, by_id string"), now).collect()}
    assert done == {"a": ("superseded", "b"), "b": ("superseded", "c"), "c": ("active", None)}
    left = {r["id"]: (r["status"], r["superseded_by"]) for r in fa.hard_delete(df, spark.createDataFrame([("b",)], "id string")).collect()}
    assert left == {"a": ("superseded", None), "c": ("active", None)}
    chunks = spark.createDataFrame([(1, "s1", "0", "p1"), (2, "s2", "2", "late"), (3, "s2", "1", ""), (4, "s2", "1-1", "p2")], "chunk_id int, session_id string, turn_range string, project string")
    assert {r["id"]: r["project"] for r in fa.backfill_projects(df, chunks).collect()} == {"a": None, "b": None, "c": "p2"}


def test_candidates_and_counts(spark):
    df = spark.createDataFrame([fact("a", entities=["x"]), fact("b", entities=["x", "y"], at=datetime(2024, 2, 1)), fact("c", "deleted", ["x"]), fact("d", entities=["x"], category="person")], FACTS)
    new = spark.createDataFrame([("n", "fact", ["x", "y", "x"]), ("m", "fact", [])], "new_id string, category string, entities array<string>")
    assert [(r["id"], r["rank"]) for r in fa.supersede_candidates(df, new).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    assert {r["status"]: r["n"] for r in fa.fact_counts(df).collect()} == {"active": 3, "superseded": 0, "deleted": 1}


def test_proposals_and_triage(spark):
    def item(i, statement="Keep it.", **more):
        return (i, json.dumps({"statement": statement, "category": "fact", "entities": ["GX10", "a/b", "x.ts", "Next.js", 3], "confidence": 1.7} | more), "s", datetime(2024, 1, int(i)), None)

    data = [item("1"), item("2", " keep   IT "), item("3", "Known"), item("4", ""), item("5", category="odd"), item("6", "Six", confidence="high", project="  "), ("7", "{", "s", T0, None), ("8", None, "s", T0, None), item("9", 5)]
    queue = spark.createDataFrame(data, "id string, proposed_fact string, session_ref string, created_at timestamp, resolved string")
    got = {r["id"]: (r["statement"], r["confidence"], r["entities"], r["project"]) for r in fa.proposals(queue).collect()}
    assert set(got) == {"1", "2", "3", "6"} and got["1"] == ("Keep it.", 1.0, ["GX10", "Next.js"], None) and got["6"][1] == 0.5 and got["6"][3] is None
    active = spark.createDataFrame([fact("a", statement="known.")], FACTS)
    assert {r["id"]: r["verdict"] for r in fa.triage_duplicates(queue, active).collect()} == {"1": "survivor", "2": "duplicate", "3": "known", "6": "survivor"}
    assert [(r["id"], r["batch"], r["place"]) for r in fa.triage_batches(queue, active).orderBy("id").collect()] == [("1", 0, 0), ("6", 0, 1)]


def test_entity_groups(spark):
    names = spark.createDataFrame([(x,) for x in ("gx10", "GX-10 box", "GX10 box two", "ab", "abc", "日本", "postgres", "Postgres")], "entity string")
    pairs = {tuple(r) for r in en.entity_pairs(names).collect()}
    assert ("Postgres", "postgres") in pairs and not any("ab" in p for p in pairs) and not any("日本" in p for p in pairs)
    groups = {r["entity"]: r["group_key"] for r in en.group_by_label(en.entity_pairs(names)).collect()}
    assert groups["gx10"] == groups["GX-10 box"] == groups["GX10 box two"] and len(groups) == 5
    assert en.group_by_label(en.entity_pairs(names.limit(0))).count() == 0


def greedy(merges, known):
    claimed, out = set(), []
    for pid, canonical, members, _reason in sorted(merges):
        ms = sorted({m for m in members or [] if m in known})
        if canonical in known and len(ms) >= 2 and canonical in ms and not claimed & set(ms):
            claimed |= set(ms)
            out.append((pid, canonical, ms))
    return out


def test_merges_claim_names_once(spark):
    merges = [(1, "a", ["a", "b"], "same"), (2, "b", ["b", "c"], "same"), (3, "c", ["c", "d", "zz"], "same"), (4, "e", ["e", "f"], "I will not merge them"), (5, "d", ["d", "e"], None), (6, "e", None, ""), (7, "e", ["e", "e"], ""), (8, "e", ["f", "e"], "")]
    df = spark.createDataFrame(merges, "proposal_id long, canonical string, members array<string>, reason string")
    names = spark.createDataFrame([(x,) for x in "abcdef"], "entity string")
    got = sorted((r["proposal_id"], r["canonical"], r["members"]) for r in en.valid_merges(df, names).collect())
    assert got == greedy([m for m in merges if m[0] != 4], set("abcdef"))
    facts = spark.createDataFrame([fact("1", entities=["b", "a", "x"]), fact("2", entities=["x"])], FACTS)
    done = {r["id"]: r["entities"] for r in en.apply_merges(facts, en.aliases(df.where("proposal_id = 1")), F.current_timestamp()).collect()}
    assert done == {"1": ["a", "x"], "2": ["x"]}


def test_cooccurrence(spark):
    df = spark.createDataFrame([fact("1", entities=["a", "b", "a"]), fact("2", entities=["b", "a"]), fact("3", "superseded", ["a", "b"]), fact("4", entities=["a", "c"])], FACTS)
    assert [tuple(r) for r in en.cooccurrence(df).collect()] == [("a", "b", 2)]
