"""Queries of the text problems (2, 4, 5, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import components, conversations, credentials, lookalikes, mixing, neardup, packing
from talkmill.llm.sql import SQL as SQL
from talkmill.llm.tokens import with_tokens
from talkmill.plans.lineage import cut
from talkmill.queries.tables import read


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """``id, statement`` of all facts and proposals."""
    facts = read(spark, folder, "facts").select("id", "statement")
    proposed = F.try_variant_get(F.try_parse_json("proposed_fact"), "$.statement", "string")
    return facts.unionByName(read(spark, folder, "review_queue").select("id", proposed.alias("statement")))


def near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(_statements(spark, folder), "id", "statement")


def near_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_groups(_statements(spark, folder), "id", "statement")


def _texts(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str]]:
    return {"turns": (read(spark, folder, "turns"), "turn_id"), "chunks": (read(spark, folder, "chunks"), "chunk_id")}


def found_credentials(spark: SparkSession, folder: str) -> DataFrame:
    rows = [df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("id"), "text") for tbl, (df, key) in _texts(spark, folder).items()]
    both = rows[0].unionByName(rows[1]).select(F.struct("tbl", "id").alias("id"), "text")
    return credentials.find(both, "id", "text").select("row_id.tbl", F.col("row_id.id").alias("row_id"), "secret")


def redacted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text held a credential, with the redacted text."""
    rows = [df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), "text") for tbl, (df, key) in _texts(spark, folder).items()]
    both = rows[0].unionByName(rows[1]).where(credentials.may_hold(F.col("text")))
    return credentials.redact(both, "text").where("redacted <> text").select("tbl", "row_id", "redacted").distinct()


def _turns_kept(spark: SparkSession, folder: str) -> DataFrame:
    zones = read(spark, folder, "devices").select("device", "zone").dropDuplicates(["device"])
    return conversations.all_conversations(
        read(spark, folder, "oc_messages"), read(spark, folder, "export_conversations"), read(spark, folder, "jsonl_records"), zones
    )


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    return _turns_kept(spark, folder).select("src", "session_key", "pos", "msg_key")


def rebuilt_report(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.report(cut(_turns_kept(spark, folder)))


def merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    return components.entity_groups(read(spark, folder, "merge_proposals"))


def fact_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per group of names that mean the same; names without a group stand for themselves."""
    names = read(spark, folder, "facts").select("id", F.explode("entities").alias("entity")).distinct()
    groups = components.entity_groups(read(spark, folder, "merge_proposals"))
    keyed = names.join(groups, "entity", "left").select("id", F.coalesce("group_key", "entity").alias("group_key")).distinct()
    return keyed.groupBy("group_key").agg(F.count("*").alias("facts"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return with_tokens(read(spark, folder, "documents").select("doc_id", "source", "text"), "text")


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(_sized(spark, folder).select("doc_id", "tokens"), read(spark, folder, "pack_specs"))


def packed_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(packed(spark, folder), read(spark, folder, "pack_specs"))


def mixed(spark: SparkSession, folder: str, budget: int | None = None) -> DataFrame:
    return mixing.mix(_sized(spark, folder), read(spark, folder, "mix_targets"), budget)


def mixed_shares(spark: SparkSession, folder: str, budget: int | None = None) -> DataFrame:
    documents, targets = cut(_sized(spark, folder)), read(spark, folder, "mix_targets")
    return mixing.shares(cut(mixing.mix(documents, targets, budget)), targets, documents)


def alike_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.reading_pairs(read(spark, folder, "documents"), "doc_id", "text")


def consistent_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.with_form(read(spark, folder, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": near_pairs,
    "p2_groups": near_groups,
    "p4_found": found_credentials,
    "p4_redacted": redacted_texts,
    "p5_found": rebuilt,
    "p5_report": rebuilt_report,
    "p6_found": merged_entities,
    "p6_facts": fact_entities,
    "p8_pack": packed,
    "p8_report": packed_report,
    "p9_mix": mixed,
    "p9_shares": mixed_shares,
    "p10_found": alike_documents,
    "p10_forms": consistent_documents,
}
