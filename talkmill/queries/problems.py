"""Queries of the general data-preparation problems (1, 3 and 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.incremental import undistilled_contents
from talkmill.operators.nested import FlatTable, columns_of, flatten, table_of
from talkmill.operators.timestamps import normalise, unreadable
from talkmill.queries.tables import read

NODES = FlatTable("nodes", "$.mapping.*", {
    "conversation": "$.conversation_id", "conversation_alt": "$.id", "title": "$.title",
    "parent": "parent", "role": "message.author.role", "create_time": "message.create_time",
})
PARTS = FlatTable("parts", "$.mapping.*.message.content.parts[]", {
    "parent": "$.mapping.*.parent", "value": "", "kind": "#type", "text": "text", "text_kind": "text#type",
})
MESSAGES = FlatTable("chat_messages", "$.chat_messages[]", {
    "uuid": "$.uuid", "name": "$.name", "sender": "sender", "created_at": "created_at", "text": "text", "text_kind": "text#type",
})
BLOCKS = FlatTable("content", "$.chat_messages[].content[]", {
    "uuid": "$.uuid", "type": "type", "text": "text", "text_kind": "text#type",
})
LINES = FlatTable("lines", "$", {
    "type": "type", "session": "sessionId", "uuid": "uuid", "parent": "parentUuid", "role": "message.role",
    "message_kind": "message#type", "content": "message.content", "content_kind": "message.content#type",
})
LINE_BLOCKS = FlatTable("line_blocks", "$.message.content[]", {
    "uuid": "$.uuid", "parent": "$.parentUuid", "type": "type", "text": "text", "text_kind": "text#type",
})


def _said(text: Column, kind: Column) -> Column:
    """A string with a character other than white space."""
    return (kind == "string") & text.rlike(r"(?U)\S")


def _export_rows(spark: SparkSession, folder: str, tables: list[FlatTable]) -> DataFrame:
    exports = read(spark, folder, "export_conversations")
    return flatten(exports, "payload", ["rec_id", "source_kind"], tables)


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``src, rec_id, node_key, parent_key, block_no``: one row per text block of both record tables.

    Each payload is parsed once; the rows of all its tables pass one projection.
    """
    table, kind = F.col("flat_table"), F.lower("source_kind")
    key, last, whole = F.get("ordinals", F.lit(0)), F.get("ordinals", F.lit(1)).cast("bigint"), F.lit(-1).cast("bigint")
    exports = _export_rows(spark, folder, [PARTS, MESSAGES, BLOCKS])
    p, m, b = map(columns_of, (PARTS, MESSAGES, BLOCKS))
    part = (table == PARTS.name) & (kind == "chatgpt") & (_said(p["value"], p["kind"]) | ((p["kind"] == "object") & _said(p["text"], p["text_kind"])))
    text = (table == MESSAGES.name) & (kind == "claude") & _said(m["text"], m["text_kind"])
    block = (table == BLOCKS.name) & (kind == "claude") & (b["type"] == "text") & _said(b["text"], b["text_kind"])
    above = F.when(table == PARTS.name, p["parent"]).when(table == MESSAGES.name, m["uuid"]).otherwise(b["uuid"])
    none = F.lit("")
    of_exports = exports.where(part | text | block).select(
        F.lit("exports").alias("src"), "rec_id", key.alias("node_key"), F.coalesce(above, none).alias("parent_key"), F.when(table == MESSAGES.name, whole).otherwise(last).alias("block_no")
    )
    lines = flatten(read(spark, folder, "jsonl_records"), "payload", ["rec_id"], [LINES, LINE_BLOCKS])
    r, t = columns_of(LINES), columns_of(LINE_BLOCKS)
    plain = (table == LINES.name) & (r["message_kind"] == "object") & _said(r["content"], r["content_kind"])
    typed = (table == LINE_BLOCKS.name) & (t["type"] == "text") & _said(t["text"], t["text_kind"])
    uuid, parent = F.when(table == LINES.name, r["uuid"]).otherwise(t["uuid"]), F.when(table == LINES.name, r["parent"]).otherwise(t["parent"])
    of_lines = lines.where(plain | typed).select(
        F.lit("jsonl").alias("src"), "rec_id", uuid.alias("node_key"), F.coalesce(parent, none).alias("parent_key"), F.when(table == LINES.name, whole).otherwise(key.cast("bigint")).alias("block_no")
    )
    return of_exports.unionByName(of_lines).distinct()


def chatgpt_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per node of each ChatGPT export, naming its record and parent node."""
    nodes = table_of(_export_rows(spark, folder, [NODES]), NODES, ["rec_id", "source_kind"])
    return nodes.where(F.lower("source_kind") == "chatgpt").select(
        "rec_id", F.coalesce("conversation", "conversation_alt").alias("conversation"), F.get("ordinals", F.lit(0)).alias("node_key"),
        F.coalesce("parent", F.lit("")).alias("parent_node"), "role",
    ).distinct()


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    """``src, rec_id, ts, utc_ms`` of every time of the exports, the JSONL records and the turns."""
    payload = F.try_parse_json("payload")

    def field(name: str) -> Column:
        return F.coalesce(*[F.try_variant_get(payload, f"{at}.{name}", "string") for at in ("$", "$[0]")])

    exports = read(spark, folder, "export_conversations").select(
        F.lit("exports").alias("src"), "rec_id", "device",
        F.when(F.lower("source_kind") == "claude", field("created_at")).otherwise(field("create_time")).alias("ts"),
    )
    lines = read(spark, folder, "jsonl_records").select(
        F.lit("jsonl").alias("src"), "rec_id", "device", F.try_variant_get(payload, "$.timestamp", "string").alias("ts")
    )
    turns = read(spark, folder, "turns").select(F.lit("turns").alias("src"), F.col("turn_id").alias("rec_id"), "device", "ts")
    zones = read(spark, folder, "devices").select("device", "zone").dropDuplicates(["device"])
    rows = exports.unionByName(lines).unionByName(turns).where(F.col("ts").isNotNull())
    return normalise(rows.join(zones, "device", "left"), "ts", "zone")


def instants(spark: SparkSession, folder: str) -> DataFrame:
    """``src, rec_id, utc_ms`` of every readable time."""
    return _dated(spark, folder).where(F.col("utc_ms").isNotNull()).select("src", "rec_id", "utc_ms").distinct()


def unreadable_times(spark: SparkSession, folder: str) -> DataFrame:
    return unreadable(_dated(spark, folder), "src", "ts")


def contents_to_distil(spark: SparkSession, folder: str) -> DataFrame:
    return undistilled_contents(read(spark, folder, "ingest_ledger"), read(spark, folder, "distill_runs"))


QUERIES = {
    "p1_found": text_blocks,
    "p1_nodes": chatgpt_nodes,
    "p3_found": contents_to_distil,
    "p7_found": instants,
    "p7_unreadable": unreadable_times,
}

SQL = {
    "p3_found": """
        WITH l AS (SELECT regexp_extract(lower(content_hash), '^\\s*(?:[a-z0-9_-]+:)?\\s*([0-9a-f]{64})\\s*$', 1) AS h, status, distilled_at FROM ingest_ledger)
        SELECT DISTINCT h AS content_hash FROM l WHERE h <> '' AND status = 'ingested' AND h NOT IN (
            SELECT l.h FROM l JOIN distill_runs r ON r.outcome = 'ok' AND l.distilled_at BETWEEN r.started_at AND r.ended_at WHERE l.h IS NOT NULL)
    """,
    "p1_nodes": """
        WITH p AS (SELECT rec_id, payload::JSON AS j FROM export_conversations WHERE lower(source_kind) = 'chatgpt' AND json_valid(payload)),
        r AS (SELECT rec_id, CASE WHEN json_type(j) = 'ARRAY' THEN j->0 ELSE j END AS j FROM p),
        n AS (SELECT rec_id, j, unnest(json_keys(j, '$.mapping')) AS k FROM r)
        SELECT DISTINCT rec_id, coalesce(j->>'$.conversation_id', j->>'$.id') AS conversation, k AS node_key,
            coalesce(json_extract_string(j, '$.mapping."' || k || '".parent'), '') AS parent_node,
            json_extract_string(j, '$.mapping."' || k || '".message.author.role') AS role
        FROM n
    """,
    "p1_found": """
        WITH p AS (SELECT rec_id, lower(source_kind) AS kind, payload::JSON AS j FROM export_conversations WHERE json_valid(payload)),
        r AS (SELECT rec_id, kind, CASE WHEN json_type(j) = 'ARRAY' THEN j->0 ELSE j END AS j FROM p),
        n AS (SELECT rec_id, key AS k, json_extract_string(value, '$.parent') AS parent, json_extract(value, '$.message.content.parts') AS parts
              FROM r, json_each(json_extract(r.j, '$.mapping')) WHERE kind = 'chatgpt'),
        c AS (SELECT rec_id, k, parent, i, json_extract(parts, '$[' || i || ']') AS v
              FROM (SELECT *, unnest(range(json_array_length(parts)::BIGINT)) AS i FROM n WHERE json_type(parts) = 'ARRAY')),
        m AS (SELECT rec_id, json_extract_string(j, '$.uuid') AS uuid, mi, json_extract(j, '$.chat_messages[' || mi || ']') AS v
              FROM (SELECT *, unnest(range(json_array_length(j, '$.chat_messages')::BIGINT)) AS mi FROM r WHERE kind = 'claude' AND json_type(j, '$.chat_messages') = 'ARRAY')),
        b AS (SELECT rec_id, uuid, mi, i, json_extract(v, '$.content[' || i || ']') AS v
              FROM (SELECT *, unnest(range(json_array_length(v, '$.content')::BIGINT)) AS i FROM m WHERE json_type(v, '$.content') = 'ARRAY')),
        x AS (SELECT rec_id, payload::JSON AS j FROM jsonl_records WHERE json_valid(payload)),
        l AS (SELECT rec_id, json_extract_string(j, '$.uuid') AS uuid, json_extract_string(j, '$.parentUuid') AS parent, json_extract(j, '$.message.content') AS v FROM x),
        y AS (SELECT rec_id, uuid, parent, i, json_extract(v, '$[' || i || ']') AS v
              FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS i FROM l WHERE json_type(v) = 'ARRAY')),
        found AS (
            SELECT 'exports' AS src, rec_id, k AS node_key, parent AS parent_key, i AS block_no, CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$') WHEN 'OBJECT' THEN CASE WHEN json_type(v, '$.text') = 'VARCHAR' THEN json_extract_string(v, '$.text') END END AS t FROM c
            UNION ALL SELECT 'exports', rec_id, mi::VARCHAR, uuid, -1, CASE WHEN json_type(v, '$.text') = 'VARCHAR' THEN json_extract_string(v, '$.text') END FROM m
            UNION ALL SELECT 'exports', rec_id, mi::VARCHAR, uuid, i, CASE WHEN json_type(v, '$.text') = 'VARCHAR' AND json_extract_string(v, '$.type') = 'text' THEN json_extract_string(v, '$.text') END FROM b
            UNION ALL SELECT 'jsonl', rec_id, uuid, parent, -1, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') END FROM l
            UNION ALL SELECT 'jsonl', rec_id, uuid, parent, i, CASE WHEN json_type(v, '$.text') = 'VARCHAR' AND json_extract_string(v, '$.type') = 'text' THEN json_extract_string(v, '$.text') END FROM y)
        SELECT DISTINCT src, rec_id, node_key, coalesce(parent_key, '') AS parent_key, block_no::BIGINT AS block_no FROM found
        WHERE regexp_matches(t, '[^\\s\\x{a0}\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')
    """,
}
