"""Prefix sums and positions over groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.plans.lineage import cut, shuffle_width


def running_total(df: DataFrame, within: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the group up to and including this one.

    A plain window would send a whole group to one task. Here rows are
    range-partitioned by (within, order), so a hot group spreads over many
    partitions; each partition sums its own part, and the sums of the parts
    before it (one row per group and partition) are added. ``order`` has to
    identify a row within its group, else ties share a partition and their
    order is arbitrary. Columns of ``within`` must not be null.
    """
    keys = [*within, *order]
    slots = shuffle_width(df.sparkSession)
    parts = cut(
        df.withColumn("__v", value)
        .repartitionByRange(slots, *keys)
        .withColumn("__slot", F.spark_partition_id())
    )
    local = Window.partitionBy(*within, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*within).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*within, "__slot").agg(F.sum("__v").alias("__s"))
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    return (
        parts.withColumn("__here", F.sum("__v").over(local))
        .join(offsets, [*within, "__slot"])
        .withColumn(out, F.col("__here") + F.col("__before"))
        .drop("__v", "__slot", "__here", "__before")
    )
