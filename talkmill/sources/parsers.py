"""Transcript formats to turns. Files come as rows ``path, device, content``.

Every parser returns the columns of :data:`talkmill.schemas.TURNS` for the
files of its kind. A file that can't be parsed gives no rows; :func:`unreadable`
names it, so it can be quarantined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.jsonstream import Found, Value, plan_of, read_records
from talkmill.functions.text import basename, blank_to_null, strip
from talkmill.schemas import TURN_FIELDS, TURNS

# Kinds of sources in the order their marks are looked for.
KINDS = ("chatgpt", "claude", "claude-code", "opencode", "vscode", "markdown")
SNIFFED = 4096
SPOKEN = ("user", "assistant")


def read_inbox(spark: SparkSession, inbox: str) -> DataFrame:
    """``path, device, content`` of the files below ``<inbox>/<device>/``; the device is the first folder."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(inbox)
    return from_files(files.withColumn("path", F.col("_metadata.file_path")), inbox)


def from_files(files: DataFrame, inbox: str) -> DataFrame:
    root = inbox.rstrip("/").removeprefix("file:")
    below = F.regexp_extract("path", f"{root}/([^/]+)/", 1)
    return files.select("path", blank_to_null(below).alias("device"), F.col("value").alias("content"))


def detect(path: Column, content: Column) -> Column:
    """Kind of a source from its name and first characters; null if nothing fits."""
    head = F.substring(content, 1, SNIFFED)
    has = lambda *keys: head.rlike("|".join(f'"{k}"' for k in keys))
    json = F.lower(path).endswith(".json")
    return (
        F.when(F.lower(path).endswith(".jsonl"), "claude-code").when(F.lower(path).endswith(".md"), "markdown")
        .when(json & has("mapping", "current_node"), "chatgpt").when(json & has("chat_messages"), "claude")
        .when(json & head.rlike(r'"source"\s*:\s*"vscode"'), "vscode").when(json & has("parts", "messages"), "opencode")
        .when(json & (basename(path) == "conversations.json"), "chatgpt")
    )


def _stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def _millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def _as_array(content: Column) -> Column:
    """A single JSON object as an array of one."""
    return F.when(F.ltrim(content).startswith("["), content).otherwise(F.concat(F.lit("["), content, F.lit("]")))


def _joined(parts: Column) -> Column:
    """Texts of the elements of type text, a line each."""
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.array_join(texts, "\n")


def _turns(rows: DataFrame) -> DataFrame:
    """Line ends to LF, blanks off the ends, empty turns out, positions from 0."""
    text = strip(F.regexp_replace("text", "\r\n", "\n"))
    kept = rows.withColumn("text", text).where(F.col("role").isin(*SPOKEN) & (F.col("text") != ""))
    items = F.array_sort(F.collect_list(F.struct("place", "role", "text", "ts")))
    keys = ["path", "session_id", "source_tool", "title", "device", "project", "started_at"]
    # The turns of one conversation come from one record of a file, so the list is as bounded as that record.
    flat = kept.groupBy(*keys).agg(items.alias("t")).select(*keys, F.posexplode("t").alias("turn_index", "x"))
    return flat.select(*keys, "turn_index", "x.role", "x.text", "x.ts").select(*TURN_FIELDS)


def parse_claude(files: DataFrame) -> DataFrame:
    block = "array<struct<type: string, text: string>>"
    kind = f"array<struct<uuid: string, name: string, created_at: string, chat_messages: array<struct<sender: string, text: string, content: {block}, created_at: string>>>>"
    records = files.select("path", "device", F.inline(F.from_json(_as_array(F.col("content")), kind))).where("uuid <> ''")
    rows = records.select("path", "device", "uuid", "name", "created_at", F.posexplode("chat_messages").alias("place", "m"))
    return _turns(rows.select(
        "path", F.concat(F.lit("claude:"), "uuid").alias("session_id"), F.lit("claude").alias("source_tool"), F.col("name").alias("title"), "device", F.lit(None).cast("string").alias("project"),
        _millis(F.col("created_at")).alias("started_at"), "place", F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"),
        F.coalesce(blank_to_null(F.col("m.text")), _joined(F.col("m.content"))).alias("text"), _millis(F.col("m.created_at")).alias("ts"),
    ))


def parse_opencode(files: DataFrame, tool: str = "opencode") -> DataFrame:
    message = "struct<role: string, content: string, parts: array<struct<type: string, text: string>>, time: struct<created: bigint>>"
    kind = f"array<struct<id: string, title: string, directory: string, time: struct<created: bigint>, messages: array<{message}>>>"
    records = files.select("path", "device", F.inline(F.from_json(_as_array(F.col("content")), kind))).where("id <> '' AND messages IS NOT NULL")
    rows = records.select("path", "device", "id", "title", "directory", F.col("time.created").alias("started_at"), F.posexplode("messages").alias("place", "m"))
    return _turns(rows.select(
        "path", F.concat(F.lit(f"{tool}:"), "id").alias("session_id"), F.lit(tool).alias("source_tool"), "title", "device", basename(F.col("directory")).alias("project"), "started_at", "place",
        F.col("m.role").alias("role"), F.coalesce(F.col("m.content"), _joined(F.col("m.parts"))).alias("text"), F.col("m.time.created").alias("ts"),
    ))


def parse_claude_code(files: DataFrame) -> DataFrame:
    """One file is one session; a line that isn't JSON makes the whole file unreadable."""
    lines = files.select("path", "device", F.posexplode(F.split("content", "\n")).alias("place", "line")).where(F.trim("line") != "")
    v = F.col("v")
    get = lambda p, kind="string": F.try_variant_get(v, p, kind)
    body = F.try_variant_get(v, "$.message.content", "variant")
    text = F.when(F.schema_of_variant(body) == "STRING", get("$.message.content")).otherwise(_joined(get("$.message.content", "array<struct<type: string, text: string>>")))
    rows = lines.withColumn("v", F.try_parse_json("line")).select(
        "path", "device", "place", v.isNull().alias("bad"), blank_to_null(get("$.sessionId")).alias("sid"), blank_to_null(get("$.cwd")).alias("cwd"), get("$.type").alias("type"), get("$.message.role").alias("role"),
        F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("side"), text.alias("text"), _millis(get("$.timestamp")).alias("ts"),
    )
    spoken = F.col("type").isin(*SPOKEN) & F.col("role").isin(*SPOKEN) & ~F.col("side") & (strip(F.col("text")) != "")
    per = rows.groupBy("path").agg(
        F.bool_or("bad").alias("broken"), F.min(F.when(F.col("sid").isNotNull(), F.struct("place", "sid"))).alias("s"), F.min(F.when(F.col("cwd").isNotNull(), F.struct("place", "cwd"))).alias("c"),
        F.min(F.when(spoken & F.col("ts").isNotNull(), F.struct("place", "ts"))).alias("t"),
    )
    good = rows.where(spoken).join(per.where("NOT broken"), "path")
    return _turns(good.select(
        "path", F.concat(F.lit("claude-code:"), F.coalesce("s.sid", _stem(F.col("path")))).alias("session_id"), F.lit("claude-code").alias("source_tool"), F.lit(None).cast("string").alias("title"), "device",
        basename(F.col("c.cwd")).alias("project"), F.col("t.ts").alias("started_at"), "place", "role", "text", "ts",
    ))


def parse_markdown(files: DataFrame) -> DataFrame:
    """One user turn per file."""
    title = F.coalesce(blank_to_null(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)), _stem(F.col("path")))
    return _turns(files.select(
        "path", F.concat(F.lit("markdown:"), _stem(F.col("path")), F.lit(":"), F.substring(F.sha2("content", 256), 1, 12)).alias("session_id"), F.lit("markdown").alias("source_tool"), title.alias("title"), "device",
        F.lit(None).cast("string").alias("project"), F.lit(None).cast("bigint").alias("started_at"), F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("content").alias("text"), F.lit(None).cast("bigint").alias("ts"),
    ))


_CHATGPT = plan_of(frozenset([
    "$.conversation_id", "$.id", "$.title", "$.create_time", "$.current_node", "$.mapping.*", "$.mapping.*.parent", "$.mapping.*.message.author.role", "$.mapping.*.message.create_time", "$.mapping.*.message.content.parts[]",
]))


def _seconds(value: Value | None) -> int | None:
    return round(float(str(value)) * 1000) if value is not None and value.kind == "number" else None


def branch(found: Found) -> list[tuple[str, str, int | None]]:
    """(role, text, ms) on the way from the root to current_node; a circle ends the walk."""
    at = lambda path, *place: found.get(path, {}).get(place)
    texts: dict[str, list[str]] = {}
    for (key, _), part in found.get("$.mapping.*.message.content.parts[]", {}).items():
        if part.kind == "string":
            texts.setdefault(key, []).append(str(part))
    current, seen, path = at("$.current_node"), set(), []
    key = str(current) if current is not None and current.kind == "string" else None
    while key is not None and key not in seen and at("$.mapping.*", key) is not None:
        seen.add(key)
        path.append(key)
        above = at("$.mapping.*.parent", key)
        key = str(above) if above is not None and above.kind == "string" else None
    out = []
    for key in reversed(path):
        role = at("$.mapping.*.message.author.role", key)
        if role is not None and role.kind == "string" and str(role) in SPOKEN:
            out.append((str(role), "\n".join(texts.get(key, ())), _seconds(at("$.mapping.*.message.create_time", key))))
    return out


def parse_chatgpt(files: DataFrame) -> DataFrame:
    """Array of conversations; of each the branch that ends in its current node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, device, content in zip(*(c.to_pylist() for c in batch.columns)):
                for _, found in read_records(content, _CHATGPT) if content.lstrip().startswith("[") else ():
                    text = lambda name, found=found: str(v) if (v := found.get(f"$.{name}", {}).get(())) is not None and v.kind != "null" else None
                    if key := text("conversation_id") or text("id"):
                        start = _seconds(found.get("$.create_time", {}).get(()))
                        rows += [(path, f"chatgpt:{key}", "chatgpt", text("title"), device, None, start, i, r, t, ms) for i, (r, t, ms) in enumerate(branch(found))]
            columns = list(zip(*rows)) or [()] * 11
            kinds = [pa.string()] * 6 + [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=TURN_FIELDS)

    flat = files.select("path", "device", "content").where("content IS NOT NULL").mapInArrow(run, TURNS)
    return _turns(flat.withColumnRenamed("turn_index", "place"))


#: Adding a source is one function here and one branch in :func:`detect`.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "chatgpt": parse_chatgpt,
    "claude": parse_claude,
    "claude-code": parse_claude_code,
    "opencode": parse_opencode,
    "vscode": lambda files: parse_opencode(files, "vscode"),
    "markdown": parse_markdown,
}


def parse_all(files: DataFrame) -> DataFrame:
    """Turns of files of any kind."""
    kinds = files.withColumn("kind", detect(F.col("path"), F.col("content")))
    out: DataFrame | None = None
    for kind, parser in PARSERS.items():
        rows = parser(kinds.where(F.col("kind") == kind).drop("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def opencode_rows(session: DataFrame, project: DataFrame, message: DataFrame, part: DataFrame, least: int = 200) -> DataFrame:
    """Turns of the relational store of one tool: sessions with their project, text parts in order, consecutive ones of a role merged, short sessions dropped.

    session(id, title, project_id, time_created), project(id, worktree),
    message(id, session_id, role, time_created), part(id, message_id, type, text).
    """
    from talkmill.operators.archive import long_sessions, merge_same_role

    owner = session.join(project.select(F.col("id").alias("project_id"), "worktree"), "project_id", "left")
    texts = message.alias("m").join(part.alias("p"), F.col("m.id") == F.col("p.message_id"), "left").where(F.col("p.type") == "text")
    rows = texts.select("m.session_id", F.col("m.time_created").alias("at"), F.col("m.id").alias("mid"), F.col("p.id").alias("pid"), "m.role", "p.text")
    merged = merge_same_role(rows, "session_id", ["at", "mid", "pid"])
    kept = merged.join(long_sessions(merged, least).select("session_id"), "session_id", "left_semi")
    named = owner.select(F.col("id").alias("session_id"), "title", basename(F.col("worktree")).alias("project"), F.col("time_created").alias("started_at"))
    return kept.join(named, "session_id").select("session_id", "title", "project", "started_at", F.col("island").alias("turn_index"), "role", "text")


def vscode_rows(turns: DataFrame, least: int = 200) -> DataFrame:
    """Turns of a store that keeps question and answer in one row (session_id, turn_index, user_message, assistant_response, timestamp)."""
    from talkmill.operators.archive import long_sessions

    both = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("user_message").alias("text")), F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("assistant_response").alias("text")))
    rows = turns.select("session_id", "turn_index", _millis(F.col("timestamp")).alias("ts"), F.explode(both).alias("x")).where("x.text <> ''")
    flat = rows.select("session_id", (F.col("turn_index") * 2 + F.col("x.side")).alias("turn_index"), "x.role", "x.text", "ts")
    return flat.join(long_sessions(flat, least).select("session_id"), "session_id", "left_semi")
