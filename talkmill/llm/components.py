"""Connected components: one group identifier for everything linked directly or through others.

Union-find runs inside edge partitions and keeps only a spanning forest of
each. Every vertex is contracted to the first of its roots in all partitions,
and the next level links what the two ends of each tree edge were contracted
to; levels go on until no link is left.
Which of two vertices comes first is drawn anew for each level, by a hash of
level and name, so names in any order contract alike: a vertex goes to the
first of a set that holds all its neighbours, and at most about 2/3 of the
vertices are expected to stay on a level, whatever the graph; the last vertex
of a level never stays, so levels always end. No level has more links than the
one before, and none needs one partition to hold the whole graph: a partition
holds about ``edges_per_task`` edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.plans.lineage import cut

EDGES_PER_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, turn of the root) of the edges (a, b, turn of a, turn of b) of one partition; the root is the first node of its tree by turn and name."""
    parent: dict[str, str] = {}
    turn: dict[str, int] = {}

    def root(x: str) -> str:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b, turn_a, turn_b in zip(*(c.to_pylist() for c in batch.columns)):
            parent.setdefault(a, a), parent.setdefault(b, b)
            turn[a], turn[b] = turn_a, turn_b
            a, b = root(a), root(b)
            if a != b:
                first, last = sorted((a, b), key=lambda x: (turn[x], x))
                parent[last] = first
    nodes = list(parent)
    for start in range(0, len(nodes), 10_000):
        part = nodes[start : start + 10_000]
        roots = [root(x) for x in part]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(roots, pa.string()), pa.array([turn[x] for x in roots], pa.int64())], names=["node", "root", "turn"])


def components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``node, group_key``: every node that occurs in an edge with the smallest node of its component.

    Order and equality are those of code points. Edges with a null end are no
    edges; repeated edges and loops don't matter (a node with only a loop is
    its own group). An empty table gives no rows. A hub that a third of all
    edges name is spread over the partitions like any other edge, by the hash
    of both ends.
    """
    links = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while count := links.count():
        turns = [F.xxhash64(F.lit(len(levels)), F.col(c)) for c in ("a", "b")]
        spread = links.repartition(-(-count // edges_per_task), "a", "b").select("a", "b", *turns)
        trees = spread.mapInArrow(_forest, "node string, root string, turn bigint")
        # The roots of one node number at most the partitions of the level.
        known = cut(trees.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("turn", "root"))).alias("roots")))
        level = known.select("node", F.col("roots")[0]["root"].alias("root"))
        levels.append(level)
        if count <= edges_per_task:  # one partition knew all links
            break
        ties = known.select(F.col("roots")[0]["root"].alias("a"), F.explode(F.array_except("roots.root", F.array("node"))).alias("node"))
        met = ties.join(level, "node").where(F.col("a") != F.col("root"))
        links = cut(met.select(F.least("a", "root").alias("a"), F.greatest("a", "root").alias("b")).distinct())
    if not levels:
        return edges.sparkSession.createDataFrame([], "node string, group_key string")
    labels = levels.pop()
    for level in reversed(levels):
        upper = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = level.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    keys = labels.groupBy("root").agg(F.min("node").alias("group_key"))
    return labels.join(keys, "root").select("node", "group_key")


def proposal_edges(proposals: DataFrame) -> DataFrame:
    """Edges ``a, b`` of merge proposals: a star from one of its names to all others, so n names give n edges.

    The centre is the canonical name, or the first member where that is null.
    Null members and proposals that name nothing give no edges. A proposal with a single
    name gives a loop, which makes the name known without linking it.
    """
    named = F.filter(F.concat(F.array("canonical"), F.coalesce("members", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    rows = proposals.select(F.array_distinct(named).alias("names")).where(F.size("names") > 0)
    return rows.select(F.col("names")[0].alias("a"), F.explode("names").alias("b"))


def entity_groups(proposals: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``entity, group_key`` of every name whose group has two or more names."""
    found = components(proposal_edges(proposals), edges_per_task=edges_per_task)
    # A group is larger than one exactly if some name other than its key belongs to it.
    others = found.where(F.col("node") != F.col("group_key"))
    keys = others.select(F.col("group_key").alias("node"), "group_key").distinct()
    return others.unionByName(keys).select(F.col("node").alias("entity"), "group_key")
