"""Retrieval quality: recall at k, mean reciprocal rank, latency percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the recall below which an evaluation fails.
GATE = 0.8


def recall_mrr(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """One row ``queries, recall, mrr`` from results (qid, session_id, rank0) and golden (qid, expected).

    A query is hit if an expected session is among its first k results; its reciprocal rank is that of the first hit.
    """
    wanted = golden.select("qid", F.explode("expected").alias("session_id")).distinct()
    first = results.where(F.col("rank0") < k).join(wanted, ["qid", "session_id"]).groupBy("qid").agg(F.min("rank0").alias("rank0"))
    per = golden.select("qid").distinct().join(first, "qid", "left")
    hit = F.col("rank0").isNotNull()
    return per.agg(F.count("*").alias("queries"), F.avg(hit.cast("double")).alias("recall"), F.avg(F.when(hit, 1 / (F.col("rank0") + 1)).otherwise(0.0)).alias("mrr"))


def misses(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """``qid, expected`` of the golden queries that none of the first k results hits."""
    wanted = golden.select("qid", F.explode("expected").alias("session_id")).distinct()
    hit = results.where(F.col("rank0") < k).join(wanted, ["qid", "session_id"], "left_semi").select("qid")
    return golden.select("qid", "expected").join(hit, "qid", "left_anti")


def gate(results: DataFrame, golden: DataFrame, k: int = 5, least: float = GATE) -> DataFrame:
    """The row of :func:`recall_mrr` with ``passed``; without a golden query nothing passes."""
    return recall_mrr(results, golden, k).withColumn("passed", F.coalesce(F.col("recall") >= least, F.lit(False)))


def nearest_rank(values: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """``n, value``: element number min(n - 1, floor(n x share)) of the sorted values, found by counting rows per value rather than sorting all in one task."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    from talkmill.plans.prefix import running_total

    placed = running_total(counts, [], ["value"], F.col("c"), "upto")
    total = counts.agg(F.sum("c")).first()[0] or 0
    at = min(total - 1, int(total * share))
    return placed.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(F.lit(total).cast("bigint").alias("n"), "value")
