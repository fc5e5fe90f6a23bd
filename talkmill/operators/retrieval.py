"""The archive's and memory's searches as calls: filters, clamps, ranking, shaping.

Results are top-k reports of at most a few dozen rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.vector import cosine
from talkmill.operators import archive as ar
from talkmill.operators import search

# Default and greatest number of results, candidates of a memory search, kilobytes of a shaped answer.
ARCHIVE_LIMITS, MEMORY_LIMITS, CANDIDATES, RESULT_KB = (5, 10), (10, 20), 50, 24
EMPTY, NO_TIMELINE, TOO_LARGE = "No archive results.", "No timeline chunks.", "[timeline exceeds the result budget — narrow the window]"
#: Vectors of texts, in order.
Embedder = Callable[[list[str]], list[list[float]]]


def _clamp(limit: int | None, limits: tuple[int, int]) -> int:
    return max(0, min(limits[0] if limit is None else limit, limits[1]))


def search_archive(archive: DataFrame, query: str, vector: list[float], limit: int | None = None, key: str = "chunk_id", vectors: str = "embedding", **filters) -> DataFrame:
    """``place, key, session_id, source_tool, project, ts, turn_range, score, text`` of the best chunks of both legs, best first.

    ``filters`` are those of :func:`search.archive_filter`; they hold before either leg is cut.
    """
    rows = archive.where(search.archive_filter(**filters))
    found = search.hybrid(rows.withColumnRenamed(vectors, "embedding"), key, query, vector, _clamp(limit, ARCHIVE_LIMITS))
    best = [(i, r[key], r["score"]) for i, r in enumerate(found.collect())]  # at most ten
    kind = rows.schema[key].dataType.simpleString()
    placed = rows.sparkSession.createDataFrame(best, f"place int, {key} {kind}, score double")
    texts = rows.select(key, "session_id", "source_tool", "project", "ts", "turn_range", "text").join(F.broadcast(placed), key).dropDuplicates([key])
    return texts.select("place", key, "session_id", "source_tool", "project", "ts", "turn_range", "score", "text").orderBy("place")


def shape_archive(results: DataFrame, kilobytes: int = RESULT_KB) -> str:
    """The results as one text: a header and the framed chunk each, as many as the budget holds; a first one beyond it is cut."""
    header = ar.archive_header(F.col("source_tool"), F.col("project"), F.col("ts"), F.col("session_id"), F.col("turn_range"), F.col("score"))
    framed = results.select("place", header.alias("header"), ar.archive_block(header, F.col("text")).alias("block"))
    return _joined(framed, kilobytes) or EMPTY


def shape_timeline(chunks: DataFrame, kilobytes: int = RESULT_KB) -> str:
    """The chunks of :func:`archive.timeline` as one text."""
    header = F.concat(F.lit("[turns="), "turn_range", F.lit("]"))
    place = F.row_number().over(_by_turn()).alias("place")
    framed = chunks.select(place, F.lit("").alias("header"), ar.archive_block(header, F.col("text")).alias("block"))
    return _joined(framed, kilobytes) or (NO_TIMELINE if chunks.isEmpty() else TOO_LARGE)


def _by_turn():
    from pyspark.sql import Window

    return Window.orderBy("turn_first", "chunk_id")


def _joined(framed: DataFrame, kilobytes: int) -> str:
    sized = framed.withColumn("size", F.length("block").cast("bigint"))
    kept = ar.budget_truncate(sized, ["place"], "size", kilobytes * 1024, "block", "header")
    return ar.SEPARATOR.join(r["block"] for r in kept.orderBy("place").collect())


def search_memory(facts: DataFrame, query: str, embedder: Embedder, category: str | None = None, project: str | None = None, limit: int | None = None) -> list[tuple[str, float]]:
    """(id, score) of the active facts that match a query in words, the nearest in meaning first.

    At most 50 candidates are embedded, in one call with the query.
    """
    rows = search.fulltext(facts, query, category, project, CANDIDATES).select("id", "statement").collect()
    if not rows:
        return []
    vectors = embedder([query, *(r["statement"] for r in rows)])
    if len(vectors) != len(rows) + 1:
        raise ValueError(f"the embedder must give {len(rows) + 1} vectors")
    data = [(r["id"], list(map(float, v))) for r, v in zip(rows, vectors[1:])]
    asked = F.array(*[F.lit(float(x)) for x in vectors[0]])
    scored = facts.sparkSession.createDataFrame(data, "id string, v array<double>").select("id", cosine(F.col("v"), asked).alias("score"))
    return [(r["id"], r["score"]) for r in search.top(scored, "id", _clamp(limit, MEMORY_LIMITS)).collect()]
