"""Exact set-similarity join for near-duplicate records, by universe partition and pigeonhole.

Two records whose sets of distinct words have Jaccard similarity of at least t
differ in at most H words, H depending on their sizes. The words are hashed
into m segments (m by size band). If a segment is required to differ in more
than v words, v being -1 (not looked at), 0 (equal) or 1 (equal but for one
word), and the sum of v + 1 over all segments exceeds H, then a similar pair
agrees in one of the looked-at segments. Every record is indexed with its
segments and their one-deletion neighbourhoods; a probing record chooses the v
of its segments with the least total number of index entries met (cost-based
allocation, a unit at a time). The numbers come from two tables of ``BUCKETS``
counters over all index entries under different hashes; of a key the smaller
counter counts, less what chance puts into any, so frequent keys stand out at any
input. They only steer the choice. Pairs that meet are verified exactly. No
similar pair is lost, whatever the allocation.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from heapq import heapify, heappop, heappush
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.components import components
from talkmill.plans.lineage import cut

THRESHOLD = Fraction(7, 10)
#: Segments per unit of H + 1; 0.5 is the least that is lossless, more leaves room to avoid frequent segments.
SLACK = 0.65
EXACT, DELETED = 0, 1
U64, SIGN = (1 << 64) - 1, 1 << 63
#: Counters of each of the two cost tables, 4 bytes each: 2 x 2 MB are broadcast, at any input.
BUCKETS = 1 << 19


@lru_cache(maxsize=1 << 16)
def most_apart(total: int, t: Fraction) -> int:
    """Most words that two sets of together ``total`` words and similarity t or more differ in."""
    return total - 2 * ceil(t * total / (1 + t))


def band_limits(largest: int, t: Fraction) -> list[tuple[int, int]]:
    """Bands of set sizes such that similar sets lie in the same or in neighbouring bands."""
    bands, low = [], 1
    while low <= largest:
        high = floor(low / t)
        bands.append((low, high))
        low = high + 1
    return bands


def segments_of(band: tuple[int, int], t: Fraction, slack: float) -> int:
    apart = max(most_apart(s, t) for s in range(band[0] * 2, band[1] * 2 + 1))
    return max(1, ceil(slack * (apart + 1)))


def _hashes(words: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in words]


def _split(hashes: list[int], count: int) -> list[list[int]]:
    parts: list[list[int]] = [[] for _ in range(count)]
    for h in hashes:
        parts[h % count].append(h)
    return parts


@lru_cache(maxsize=1 << 16)
def _place(kind: int, band: int, segment: int) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {band} {segment}")


def _keys(kind: int, band: int, segment: int, part: list[int], without_one: bool) -> list[int]:
    """Key of a segment's words, or of all but each one of them: the sum of their hashes, so leaving one out is a subtraction."""
    whole = sum(part) + _place(kind, band, segment)
    return [((whole - h) & U64) - SIGN for h in part] if without_one else [(whole & U64) - SIGN]


def _parities(hashes: list[int]) -> int:
    """64 bits, each the parity of the number of words hashed to it. Two sets differ in at least as many words as bits."""
    bits = 0
    for h in hashes:
        bits ^= 1 << (h >> 58)
    return bits - (1 << 64) if bits >> 63 else bits


def allocate(costs: list[tuple[int, int]], units: int) -> list[int]:
    """v of each segment with the least cost such that the sum of v + 1 is at least ``units``; costs are those of v = 0 and v = 1.

    One unit more is bought at a time, at best by a step up of one segment or by
    two of one and a step down of another: any cheaper change would hold one of
    these or one that gains without a unit, which a best choice doesn't leave. So
    the time grows with the units, not with their square.
    """
    # By kind of step: (price, segment, v it starts from); entries of segments that have moved on are skipped.
    single = [(equal, i, -1) for i, (equal, _) in enumerate(costs)]
    double = [(near, i, -1) for i, (_, near) in enumerate(costs)]
    back: list[tuple[int, int, int]] = []
    heapify(single), heapify(double)
    out = [-1] * len(costs)

    def top(heap: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
        while heap and out[heap[0][1]] != heap[0][2]:
            heappop(heap)
        return heap[0] if heap else None

    def move(i: int, v: int) -> None:
        out[i] = v
        equal, near = costs[i]
        if v == -1:
            heappush(single, (equal, i, -1)), heappush(double, (near, i, -1))
        elif v == 0:
            heappush(single, (near - equal, i, 0)), heappush(back, (-equal, i, 0))
        else:
            heappush(back, (equal - near, i, 1))

    for _ in range(min(units, 2 * len(costs))):
        one, two, down = top(single), top(double), top(back)
        if two is not None and down is not None and (one is None or two[0] + down[0] < one[0]):
            move(two[1], 1)
            move(down[1], down[2] - 1)
        else:
            move(one[1], one[2] + 1)
    return out


def _other(keys: np.ndarray) -> np.ndarray:
    """The bucket of each key under the second hash."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64) % BUCKETS


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, words``: the sorted distinct words of each text; rows without a word or key are left out."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))))
    rows = df.select(F.col(key).alias("key"), words.alias("words"))
    return rows.where(F.col("key").isNotNull() & (F.size("words") > 0)).distinct()


def similar_sets(sets: DataFrame, t: Fraction = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """``sid_a, sid_b`` of all pairs of different sets with similarity t or more, from ``sid bigint, words`` (distinct, stored)."""
    spark = sets.sparkSession
    largest = sets.agg(F.max(F.size("words"))).first()[0] or 0
    limits = band_limits(largest, t)
    counts = [segments_of(b, t, slack) for b in limits]
    band_at = [0] * (largest + 1)
    for i, (low, high) in enumerate(limits):
        for size in range(low, min(high, largest) + 1):
            band_at[size] = i

    def entries_of(hashes: list[int]) -> list[int]:
        band, found = band_at[len(hashes)], []
        for i, part in enumerate(_split(hashes, counts[band])):
            found += _keys(EXACT, band, i, part, False)
            found += _keys(DELETED, band, i, part, True)
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            keys = np.array([k for words in batch.column(0).to_pylist() for k in entries_of(_hashes(words))], np.int64)
            table += np.bincount(np.concatenate([keys % BUCKETS, BUCKETS + _other(keys)]), minlength=2 * BUCKETS)
        used = np.nonzero(table)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(table[used], pa.int64())], names=["bucket", "n"])

    def rows_of(found: list[tuple[list[int], int, int, int]], names: list[str]) -> pa.RecordBatch:
        """Keys with the record's sid, size and parities repeated for each."""
        times = [len(x[0]) for x in found]
        columns = [np.fromiter((k for x in found for k in x[0]), np.int64, sum(times))]
        columns += [np.repeat(np.array([x[c] for x in found], kind), times) for c, kind in ((1, np.int64), (2, np.int32), (3, np.int64))]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = _hashes(words)
                found.append((entries_of(hashes), s, len(words), _parities(hashes)))
            yield rows_of(found, ["key", "sid_b", "size_b", "bits_b"])

    def chosen_keys(hashes: list[int], met: np.ndarray) -> list[int]:
        size, found = len(hashes), []
        for band in {band_at[size], max(0, band_at[size] - 1)}:
            low, high = max(limits[band][0], ceil(t * size)), min(limits[band][1], size)
            units = max((most_apart(size + x, t) for x in range(low, high + 1)), default=-1) + 1
            if units < 1:
                continue
            ways = []
            for i, part in enumerate(_split(hashes, counts[band])):
                equal = _keys(EXACT, band, i, part, False)
                ways.append((equal, equal + _keys(DELETED, band, i, part, False) + _keys(EXACT, band, i, part, True)))
            asked = np.array([k for _, near in ways for k in near], np.int64)
            prices = np.maximum(np.minimum(met[asked % BUCKETS], met[BUCKETS + _other(asked)]) - chance, 1).tolist()
            costs, at = [], 0
            for _, near in ways:
                costs.append((prices[at], sum(prices[at : at + len(near)])))
                at += len(near)
            for v, (equal, near) in zip(allocate(costs, units), ways):
                found += equal if v == 0 else near if v == 1 else []
        return found

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = table.value
        for batch in batches:
            found = []
            for s, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = _hashes(words)
                found.append((chosen_keys(hashes, met), s, len(words), _parities(hashes)))
            yield rows_of(found, ["key", "sid", "size", "bits"])

    if not limits:
        return spark.createDataFrame([], "sid_a bigint, sid_b bigint")
    counted = sets.select("words").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    costs = np.zeros(2 * BUCKETS, np.int64)
    costs[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    chance = int(costs.sum()) // (2 * BUCKETS)
    table = spark.sparkContext.broadcast(np.minimum(costs, 2**31 - 1).astype(np.int32))
    chosen = sets.select("sid", "words").mapInArrow(probe, "key bigint, sid bigint, size int, bits bigint")
    entries = sets.select("sid", "words").mapInArrow(index, "key bigint, sid_b bigint, size_b int, bits_b bigint")
    ordered = (F.col("size_b") < F.col("size")) | ((F.col("size_b") == F.col("size")) & (F.col("sid_b") < F.col("sid")))
    total, whole = F.col("size") + F.col("size_b"), t.numerator + t.denominator
    apart = total - 2 * F.floor((total * t.numerator + (whole - 1)) / whole)  # as most_apart
    fits = (F.col("size_b") * t.denominator >= F.col("size") * t.numerator) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b"))) <= apart)
    pairs = chosen.join(entries, "key").where(ordered & fits).select(F.col("sid").alias("sid_a"), "sid_b").distinct()
    a, b = sets.select(F.col("sid").alias("sid_a"), F.col("words").alias("wa")), sets.select(F.col("sid").alias("sid_b"), F.col("words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    similar = common * (t.numerator + t.denominator) >= (F.size("wa") + F.size("wb")) * t.numerator
    return pairs.join(a, "sid_a").join(b, "sid_b").where(similar).select("sid_a", "sid_b")


def _sets_and_members(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(word_sets(df, key, text))
    sets = cut(rows.select("words").distinct().withColumn("sid", F.monotonically_increasing_id()))
    return sets, cut(rows.join(sets, "words").select("key", "sid"))


def similar_pairs(df: DataFrame, key: str, text: str, t: Fraction = THRESHOLD) -> DataFrame:
    """``id_a, id_b``: different keys whose texts have word sets of similarity t or more, the smaller key first.

    Equal word sets are joined once, as one set; their keys are paired at the
    end. Nulls and texts without a letter or digit pair with nothing; repeated
    rows count once; a key with several texts counts with each.
    """
    sets, members = _sets_and_members(df, key, text)
    links = similar_sets(sets, t)
    a, b = members.toDF("key_a", "sid_a"), members.toDF("key_b", "sid_b")
    near = links.join(a, "sid_a").join(b, "sid_b").select("key_a", "key_b")
    same = a.join(b, F.col("sid_a") == F.col("sid_b")).select("key_a", "key_b").where("key_a < key_b")
    pairs = near.unionByName(same).where("key_a <> key_b")
    return pairs.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b")).distinct()


def similar_groups(df: DataFrame, key: str, text: str, t: Fraction = THRESHOLD) -> DataFrame:
    """``id, group_key, links``: each key with its group (the smallest key linked directly or through others) and the number of other texts it is linked with.

    Works on one representative per word set, so a group of copies costs its
    size, not its square. A key without words is a group of its own.
    """
    sets, members = _sets_and_members(df, key, text)
    links = cut(similar_sets(sets, t))
    first = members.groupBy("sid").agg(F.min("key").alias("rep"))
    a, b = first.toDF("sid_a", "rep_a"), first.toDF("sid_b", "rep_b")
    # A key with several texts ties their sets, so each key is linked with the representative of its set.
    edges = links.join(a, "sid_a").join(b, "sid_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    edges = edges.unionByName(members.join(first, "sid").select(F.col("rep").alias("a"), F.col("key").alias("b")))
    groups = components(edges)
    both = links.select(F.col("sid_a").alias("sid")).unionByName(links.select(F.col("sid_b").alias("sid")))
    degree = members.join(both.groupBy("sid").agg(F.count("*").alias("links")), "sid", "left").groupBy("key").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    keys = df.select(F.col(key).cast("string").alias("id")).dropna().distinct()
    found = keys.join(groups.withColumnRenamed("node", "id"), "id", "left").join(degree.select(F.col("key").cast("string").alias("id"), "links"), "id", "left")
    return found.select("id", F.coalesce("group_key", "id").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))
