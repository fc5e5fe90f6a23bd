"""Exact nearest neighbours of a stated set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000


def knn(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int, block: int = BLOCK) -> DataFrame:
    """``qid, key, score, rank0``: the k vectors of greatest cosine for each query (qid, vector), itself left out.

    Queries are taken ``block`` at a time, so what travels to the tasks is
    bounded; every task keeps its best k per query before anything is shuffled. Null vectors are no neighbours.
    """
    count = queries.count()
    numbered = queries.select("qid", F.col(column).alias("v")).where("v IS NOT NULL")
    parts = max(1, -(-count // block))
    kind = vectors.schema[key].dataType.simpleString()
    out: DataFrame | None = None
    for part in range(parts):
        rows = numbered.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()  # one block of about ``block`` rows
        if not rows:
            continue
        ids = [r["qid"] for r in rows]
        matrix = np.array([r["v"] for r in rows], np.float64).reshape(len(ids), -1)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, unit=unit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_pylist()
                rows = np.array(batch.column(1).to_pylist(), np.float64)
                size = np.linalg.norm(rows, axis=1, keepdims=True)
                scores = unit @ np.divide(rows, size, out=np.zeros_like(rows), where=size > 0).T
                few = min(k + 1, len(keys))
                at = np.argpartition(-scores, few - 1, axis=1)[:, :few]
                # Ties at the border must not be cut by chance, so everything that reaches the border's score is kept.
                border = np.take_along_axis(scores, at, 1).min(1)
                q, c = np.nonzero(scores >= border[:, None] - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], pa.int64()), pa.array([keys[i] for i in c]), pa.array(scores[q, c])], names=["qid", "key", "score"])

        found = vectors.select(key, column).where(F.col(column).isNotNull()).mapInArrow(best, f"qid bigint, key {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"qid bigint, {key} {kind}, score double, rank0 bigint")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))
    rows = out.where("qid <> key").withColumn("score", F.round("score", 9)).withColumn("rank0", (rank - 1).cast("bigint"))
    return rows.where(F.col("rank0") < k).withColumnRenamed("key", key)
