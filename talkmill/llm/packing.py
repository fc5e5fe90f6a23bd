"""Filling containers of fixed capacity by linear grouping.

Texts are dealt into shards of at most about ``SHARD`` texts by a hash of their
key, and each shard is packed on its own (a shard wastes less than a container
more than the whole would). Within a shard, large texts are sorted and cut into
groups of equal number; each group's sizes are rounded up to its largest. Over
these few sizes all configurations of one container are known, for at most three
large texts fit, and a linear program finds how often to use each so that the
containers are fewest. The actual texts take the places of their rounded sizes;
what the program's fractions leave over, and the small texts, are best-fitted into
the space left. A shard for which plain best-fit of the sorted texts needs fewer
containers takes that, so none ever needs more.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.plans.lineage import cut

SHARD = 50_000
GROUPS = 48
#: A text larger than this share of the capacity is large.
LARGE = 0.25
#: Steps of the linear program; what it holds after them is valid, if not the best.
STEPS = 2000
MOST_SPECS = 1000
RESULT = "spec_id int, shard int, bin bigint, pos bigint, doc_id bigint, piece bigint, tokens bigint"


Item = tuple[int, object]


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All ways (size, configuration) to fill a container with one to three of the sizes."""
    kinds = range(len(sizes))
    fits = [c for n in (1, 2, 3) for c in combinations_with_replacement(kinds, n) if n == 1 or sum(sizes[k] for k in c) <= capacity]
    out = np.zeros((len(sizes), len(fits)))
    for i, c in enumerate(fits):
        for k in c:
            out[k, i] += 1
    return out


def fewest(ways: np.ndarray, counts: list[int]) -> list[tuple[int, float]]:
    """(configuration, times) of the fractional use of configurations that holds ``counts`` with the fewest containers: the simplex method.

    It starts from each size alone, which the first configurations are.
    """
    need = np.array(counts, float)
    basis = list(range(len(counts)))
    inverse, times = np.eye(len(counts)), need.copy()
    for _ in range(STEPS):
        worth = inverse.sum(0)  # of one more text of each size, in containers
        gain = worth @ ways
        enter = int(gain.argmax())
        if gain[enter] <= 1 + 1e-9:
            break
        direction = inverse @ ways[:, enter]
        held = np.full(len(times), np.inf)
        np.divide(times, direction, out=held, where=direction > 1e-9)
        leave = int(held.argmin())
        basis[leave] = enter
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        times = np.maximum(inverse @ need, 0)
    return [(b, float(t)) for b, t in zip(basis, times) if t > 0]


def best_fit(items: list[Item], capacity: int, bins: list[list[Item]]) -> list[list[Item]]:
    """``bins`` with the items, in order, each in the container it fills most, in a new one where none has room."""
    space = sorted((capacity - sum(s for s, _ in b), i) for i, b in enumerate(bins))
    for item in items:
        at = bisect_left(space, (item[0], -1))
        if at < len(space):
            free, i = space.pop(at)
        else:
            free, i = capacity, len(bins)
            bins.append([])
        bins[i].append(item)
        insort(space, (free - item[0], i))
    return bins


def planned(large: list[Item], small: list[Item], capacity: int) -> list[list[Item]]:
    """Containers by linear grouping; both lists come largest first."""
    per = -(-len(large) // GROUPS)
    groups = [large[i : i + per] for i in range(0, len(large), per)]
    ways = configurations([g[0][0] for g in groups], capacity)
    bins: list[list[Item]] = []
    for configuration, times in fewest(ways, list(map(len, groups))):
        for _ in range(int(times + 1e-6)):
            kinds = [k for k in np.nonzero(ways[:, configuration])[0] for _ in range(int(ways[k, configuration]))]
            if all(len(groups[k]) >= kinds.count(k) for k in kinds):
                bins.append([groups[k].pop() for k in kinds])
    left = sorted((x for g in groups for x in g), key=lambda x: (-x[0], str(x[1])))
    return best_fit(left + small, capacity, bins)


def pack(items: list[Item], capacity: int) -> list[list[Item]]:
    """Containers of (size, item) whose sizes sum to at most ``capacity``; every size must be at most that."""
    items = sorted(items, key=lambda x: (-x[0], str(x[1])))
    large = [x for x in items if x[0] > capacity * LARGE]
    plain = best_fit(items, capacity, [])
    if not large:
        return plain
    by_groups = planned(large, items[len(large) :], capacity)
    return by_groups if len(by_groups) <= len(plain) else plain


def _pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs rows (spec_id, shard, capacity, doc_id, tokens, piece) that come sorted by the first two."""

    def flush(key: tuple, rows: list[tuple[int, object]]) -> pa.RecordBatch:
        out = [(key[0], key[1], b, p, doc, piece, size) for b, content in enumerate(pack(rows, key[2])) for p, (size, (doc, piece)) in enumerate(content)]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["spec_id", "shard", "bin", "pos", "doc_id", "piece", "tokens"])

    key, rows = None, []
    for batch in batches:
        for spec, shard, capacity, doc, tokens, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (spec, shard, capacity) != key:
                if rows:
                    yield flush(key, rows)
                key, rows = (spec, shard, capacity), []
            rows.append((tokens, (doc, piece)))
    if rows:
        yield flush(key, rows)


def fill(documents: DataFrame, specs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``spec_id, container, pos, doc_id, piece, tokens``: where each text, or piece of an overlong one, lies.

    ``documents``: doc_id, tokens (unique ids; repeated ids are packed once,
    the largest size counts). ``specs``: spec_id, capacity_tokens; specs
    without a positive capacity fill nothing. A text is cut only if it alone
    exceeds the capacity, into whole containers and a rest; pieces count from 0. Texts
    without tokens take a place of size 0. Null ids or sizes are left out.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("bigint").alias("tokens")).dropna()
    docs = cut(docs.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    shards = max(1, -(-docs.count() // shard))
    wanted = specs.where("capacity_tokens > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    # One row per spec: specs are few, so each document meets them in an array rather than in a join.
    few = [(r["spec_id"], r["capacity"]) for r in wanted.orderBy("spec_id").limit(MOST_SPECS + 1).collect()]
    if len(few) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    if not few:
        return documents.sparkSession.createDataFrame([], "spec_id int, container string, pos bigint, doc_id bigint, piece bigint, tokens bigint")
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in few]))
    rows = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("s", spec).select("s.*", "shard", "doc_id", "tokens")
    whole = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("bigint")
    pieces = rows.select("spec_id", "shard", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
    size = F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity"))
    sized = pieces.select("spec_id", "shard", "capacity", "doc_id", size.alias("tokens"), "piece")
    packed = sized.repartition(shards * len(few), "spec_id", "shard").sortWithinPartitions("spec_id", "shard").mapInArrow(_pack_groups, RESULT)
    return packed.select("spec_id", F.concat_ws("-", "spec_id", "shard", "bin").alias("container"), "pos", "doc_id", "piece", "tokens")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, containers, tokens, fill``: how full the containers are on the whole."""
    totals = packed.groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return totals.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select(
        "spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill")
    )
