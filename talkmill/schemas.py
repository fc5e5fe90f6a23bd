"""Schemas of the engine's tables as DDL. All columns may be null."""

TURNS = "path string, session_id string, source_tool string, title string, device string, project string, started_at bigint, turn_index int, role string, text string, ts bigint"
TURN_FIELDS = [field.split()[0] for field in TURNS.split(", ")]
ARCHIVE = "point_id string, session_id string, source_tool string, device string, project string, ts bigint, turn_range string, text string, content_hash string, dense array<float>"
FACTS = (
    "id string, statement string, category string, entities array<string>, confidence float, source string, provenance array<struct<session_id: string, chunk_id: string>>, "
    "project string, status string, superseded_by string, created_at timestamp, updated_at timestamp"
)
LEDGER = "id string, source_path string, source_kind string, content_hash string, sessions int, chunks int, secrets_found int, status string, distilled_at timestamp, ingested_at timestamp"
LEDGER_SESSIONS = "ledger_id string, session_id string"
REVIEW_QUEUE = "id string, proposed_fact string, session_ref string, created_at timestamp, resolved string"
# The graph tables exist so that a schema check finds them; nothing fills them.
ENTITIES = "id string, name string, kind string"
RELATIONS = "id string, src string, dst string, kind string"
TABLES = {"facts": FACTS, "archive": ARCHIVE, "ingest_ledger": LEDGER, "ledger_sessions": LEDGER_SESSIONS, "review_queue": REVIEW_QUEUE, "entities": ENTITIES, "relations": RELATIONS}
