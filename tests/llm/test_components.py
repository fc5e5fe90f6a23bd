import random

from pyspark.sql import functions as F

from talkmill.llm.components import components, entity_groups, proposal_edges


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_chains_hubs_and_levels(spark, rows):
    rng = random.Random(1)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(300) if i % 50] + [("hub", f"x{i}") for i in range(300)] + [(f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(250)] + [("日", "é"), ("self", "self"), ("a", "b"), ("b", "a")]
    df = rows(edges * 2 + [(None, "a"), ("a", None), (None, None)], "a string, b string")
    got = {r["node"]: r["group_key"] for r in components(df, edges_per_task=40).collect()}
    assert got == brute(edges)


def test_ordered_chain_converges(spark, rows):
    """As many partitions as links: names in ascending order need no more levels than others."""
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)]
    got = components(rows(edges, "a string, b string"), edges_per_task=1).collect()
    assert len(got) == 201 and {r["group_key"] for r in got} == {"n000"}


def test_empty_and_clashing_columns(spark, rows):
    assert components(rows([], "a string, b string")).count() == 0
    df = rows([("y", "z", "n", "r")], "a string, b string, node string, root string")
    assert sorted(map(tuple, components(df).collect())) == [("y", "y"), ("z", "y")]


def test_proposals(spark, rows):
    data = [("a", ["b", "a", None, "a"]), ("b", ["c"]), ("x", None), ("y", []), (None, ["p", "q"]), (None, None), ("B", ["b "]), ("s", ["s"]), ("", ["e"])]
    df = rows(data + data[:2], "canonical string, members array<string>").withColumn("entity", F.lit("clash"))
    got = {r["entity"]: r["group_key"] for r in entity_groups(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "p": "p", "q": "p", "B": "B", "b ": "B", "": "", "e": ""}
    assert proposal_edges(df).where("a = 'x' AND b = 'x'").count() == 1
    assert entity_groups(df.limit(0)).count() == 0


def test_very_long_names(spark, rows):
    long = "n" * 200_000
    assert {r["group_key"] for r in components(rows([(long, "a"), ("a", long + "2")], "a string, b string")).collect()} == {"a"}
