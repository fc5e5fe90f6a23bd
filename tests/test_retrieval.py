import pytest

from talkmill.operators import archive as ar
from talkmill.operators import retrieval as rt

CHUNKS = "chunk_id bigint, session_id string, source_tool string, project string, ts bigint, turn_range string, text string, embedding array<double>"
FACTS = "id string, statement string, category string, project string, status string"


@pytest.fixture()
def chunks(rows):
    data = [(i, f"s{i % 3}", "claude" if i % 2 else "opencode", None, 1_700_000_000_000, f"{i}", f"tunnel note {i} " + "pump " * i, [1.0, float(i)]) for i in range(40)]
    return rows(data + data[:3], CHUNKS)


def test_archive_search_is_clamped_filtered_and_ranked(chunks):
    found = rt.search_archive(chunks, "pump", [1.0, 0.0], 100).collect()
    assert len(found) == 10 and [r["place"] for r in found] == list(range(10)) and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert len(rt.search_archive(chunks, "pump", [1.0, 0.0]).collect()) == 5 and rt.search_archive(chunks, "pump", [1.0, 0.0], -3).count() == 0
    only = rt.search_archive(chunks, "pump", [1.0, 0.0], 10, source_tool="claude", project=" ").collect()
    assert {r["source_tool"] for r in only} == {"claude"} and len({r["chunk_id"] for r in only}) == len(only)
    assert rt.search_archive(chunks.limit(0), "pump", [1.0, 0.0]).count() == 0


def test_shaping(chunks):
    found = rt.search_archive(chunks, "pump", [1.0, 0.0], 3)
    text = rt.shape_archive(found)
    assert text.count("<<<archive-chunk") == 3 and text.startswith("[") and " / 2023-11-14] session=" in text and text.endswith("\n>>>")
    assert rt.shape_archive(found.limit(0)) == "No archive results."
    long = found.limit(1).selectExpr("place", "chunk_id", "session_id", "source_tool", "project", "ts", "turn_range", "score", "repeat('x', 5000) AS text")
    cut = rt.shape_archive(long, 1)
    assert cut.endswith("x\n[truncated]\n>>>") and len(cut) == 1024 - 20 + len("\n[truncated]\n>>>")
    near = ar.timeline(chunks.dropDuplicates(["chunk_id"]), "s0", 9, 1)
    assert [x.split("]")[0] for x in rt.shape_timeline(near).split("\n\n")] == ["[turns=6", "[turns=9", "[turns=12"]
    assert rt.shape_timeline(near.limit(0)) == "No timeline chunks."


def test_memory_search(rows):
    facts = rows([(f"f{i:02}", f"the pump number {i}", "fact", "harrow" if i % 2 else None, "active") for i in range(30)] + [("gone", "the pump", "fact", None, "superseded")], FACTS)
    asked = []

    def vectors(texts):
        asked.append(len(texts))
        return [[1.0, float(t.split()[-1]) if t.split()[-1].isdigit() else 0.0] for t in texts]

    found = rt.search_memory(facts, "pump", vectors, limit=99)
    assert len(found) == 20 and found[0][0] == "f00" and asked == [31] and all(a[1] >= b[1] for a, b in zip(found, found[1:]))
    assert len(rt.search_memory(facts, "pump", vectors)) == 10 and len(rt.search_memory(facts, "pump", vectors, project="harrow", limit=20)) == 15
    assert rt.search_memory(facts, "nothing", vectors) == [] and len(asked) == 3
    with pytest.raises(ValueError):
        rt.search_memory(facts, "pump", lambda texts: [])
