"""Reading the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its zoneless timestamps taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in zoneless}) if zoneless else df
