"""Cutting the lineage of iterative jobs on storage every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder.

    Only an in-process ``local[...]`` master without the setting (tests) gets a
    temporary folder; any other master without it is an error, because a folder
    of one machine would not survive the loss of that machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="talkmill-checkpoint-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` on the cluster, as
    the sessions made here do, so that a copy goes when nothing refers to it any
    more; :func:`drop_checkpoints` removes what a finished application left.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoints(spark: SparkSession) -> None:
    """Remove this application's checkpoints, when its results are written."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a wide stage should use in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
