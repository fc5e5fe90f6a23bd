"""Reports over ledger, queue, archive and facts, and the pages of the vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger_stats(ledger: DataFrame) -> DataFrame:
    rows = ledger.where("status = 'ingested'")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return rows.agg(F.count("*").alias("files"), total("sessions"), total("chunks"), total("secrets_found"), F.unix_millis(F.max("ingested_at")).alias("last_ingest_ms"))


def undistilled(ledger: DataFrame) -> DataFrame:
    """Ingested rows without a mark, oldest first."""
    return ledger.where("status = 'ingested' AND distilled_at IS NULL").orderBy("ingested_at", "id")


def vault_category(facts: DataFrame) -> DataFrame:
    """``category, lines``: the number of lines of each category page."""
    return facts.where("status = 'active'").groupBy("category").agg(F.count("*").alias("lines"))


def vault_lines(facts: DataFrame) -> DataFrame:
    """``page, place, line``: the lines of the category pages in order; pages are written from it without gathering one in memory."""
    mentions = F.when(F.size("entities") > 0, F.concat(F.lit(" _("), F.array_join("entities", ", "), F.lit(")_"))).otherwise("")
    line = F.concat(F.lit("- "), "statement", mentions, F.lit(" <!-- fact:"), "id", F.lit(" source:"), "source", F.lit(" -->"))
    rows = facts.where("status = 'active'")
    return rows.select(F.concat("category", F.lit(".md")).alias("page"), F.struct("created_at", "id").alias("place"), line.alias("line"))


def vault_entity(facts: DataFrame) -> DataFrame:
    """``entity, category, facts``: the sections of the entity pages."""
    rows = facts.where("status = 'active'").select("category", F.explode("entities").alias("entity"))
    return rows.groupBy("entity", "category").agg(F.count("*").alias("facts"))


def daily_log(facts: DataFrame) -> DataFrame:
    """``day, learned, superseded`` by UTC day; a day with either appears."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    learned = facts.groupBy(day("created_at")).agg(F.count("*").alias("learned"))
    gone = facts.where("status = 'superseded'").groupBy(day("updated_at")).agg(F.count("*").alias("superseded"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return learned.join(gone, "day", "full").select("day", zero("learned"), zero("superseded"))


def write_vault(facts: DataFrame, folder: str) -> None:
    """The category pages as text files, one folder per page, in order. Replaces what was there."""
    rows = vault_lines(facts).repartitionByRange("page", "place").sortWithinPartitions("page", "place")
    rows.select("page", F.col("line").alias("value")).write.mode("overwrite").partitionBy("page").text(folder)
