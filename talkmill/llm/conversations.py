"""Rebuilding ordered conversations from message rows and nodes.

All sources are brought to one narrow form (message, parent, time, role, whether
it is a turn) and partitioned by conversation once; what makes a conversation
broken, its order and its completeness are decided where its rows meet. Each
reply graph is sorted topologically with Kahn's algorithm; nodes that are ready
at the same time come by time, so the order is that of (latest time on the way
from the root, depth, own time, key). Nodes left over lie on or behind a circle
or name a parent that isn't there. Graphs of more than ``GRAPH_LIMIT`` messages
are never gathered: their depth and latest time come from pointer doubling and
give the same order. Conversations that are broken, have no user turn or don't
end with the assistant are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.jsonstream import Found, plan_of, read_records
from talkmill.operators.timestamps import normalise
from talkmill.plans.lineage import cut
from talkmill.plans.prefix import running_total

GRAPH_LIMIT = 100_000
# Spellings of the roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "ai": "assistant", "system": "system", "tool": "tool"}
NO_TIME = (1 << 62) - 1
MESSAGE = "src string, session_key string, msg_key string, parent string, time bigint, role string, said boolean, bad boolean"
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
TURNS = "src string, session_key string, pos bigint, msg_key string, role string"


def kahn(parents: dict[str, str | None], times: dict[str, int | None]) -> tuple[list[str], set[str]]:
    """(nodes in order, nodes left over) of a reply graph given by each node's parent.

    A parent that is no node of the graph leaves its children over, as a circle does.
    """
    children: dict[str, list[str]] = {}
    ready: list[tuple[int, int, int, str]] = []
    at = lambda n: NO_TIME if times.get(n) is None else times[n]
    for node, parent in parents.items():
        if parent is None:
            ready.append((at(node), 0, at(node), node))
        else:
            children.setdefault(parent, []).append(node)
    heapq.heapify(ready)
    order: list[str] = []
    while ready:
        latest, depth, _, node = heapq.heappop(ready)
        order.append(node)
        for child in children.get(node, ()):
            heapq.heappush(ready, (max(latest, at(child)), depth + 1, at(child), child))
    return order, set(parents) - set(order)


def alternates(roles: list[str]) -> bool:
    """Whether user and assistant take turns. Several turns of one role in a row don't break a conversation; :func:`report` counts them."""
    return all(a != b for a, b in zip(roles, roles[1:]))


def complete(roles: list[str]) -> bool:
    """Whether a conversation has a user turn and ends with an answer."""
    return "user" in roles and roles[-1] == "assistant"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((source, session), rows) of batches sorted by their first two columns."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != current:
                if rows:
                    yield current, rows
                current, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield current, rows


def _no_nulls(row: tuple) -> tuple:
    """A key that sorts nulls first."""
    return tuple((x is not None, x) for x in row)


def ordered_turns(src: str, rows: list[tuple]) -> list[tuple[str, str]]:
    """(message, role) of the turns of one conversation in order; none if it isn't kept. Rows are (msg_key, parent, time, role, said, bad)."""
    if any(row[5] or row[0] is None for row in rows if row[3] is not None or row[5] or src == "oc"):
        return []
    nodes: dict[str, tuple] = {}
    for key, *rest, _ in rows:
        if key is None or rest[2] is None and src != "oc":
            continue  # no message of the conversation
        known = nodes.get(key)
        if known is not None:  # a message counts once, with the least of what its copies say
            said = known[3] or rest[3]
            rest = min(known, tuple(rest), key=lambda r: _no_nulls((NO_TIME if r[1] is None else r[1], r[0], r[2])))
            rest = (*rest[:3], said)
        nodes[key] = tuple(rest)
    if src == "oc" and any(n[1] is None or n[2] is None for n in nodes.values()):
        return []
    order, left = kahn({k: n[0] for k, n in nodes.items()}, {k: n[1] for k, n in nodes.items()})
    if left:
        return []
    if src == "oc":  # these rows are ordered by time alone
        order.sort(key=lambda k: (nodes[k][1], k))
    turns = [(k, nodes[k][2]) for k in order if nodes[k][3] and nodes[k][2] in ("user", "assistant")]
    return turns if turns and complete([r for _, r in turns]) else []


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str, int, str, str]] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in TURNS.split(", ")])

    for (src, session), rows in _sorted_groups(batches):
        out.extend((src, session, i, key, role) for i, (key, role) in enumerate(ordered_turns(src, rows)))
        if len(out) > 20_000:
            yield flush()
    yield flush()


def _large_turns(messages: DataFrame, most: int) -> DataFrame:
    """As :func:`ordered_turns`, for conversations too large for one task: joins for what is broken, pointer doubling for the order."""
    key = ["src", "session_key"]
    oc = F.col("src") == "oc"
    counted = messages.where(F.col("role").isNotNull() | F.col("bad") | oc)
    bad = counted.where(F.col("bad") | F.col("msg_key").isNull() | oc & (F.col("role").isNull() | F.col("time").isNull())).select(*key)
    least = F.min(F.struct(F.coalesce("time", F.lit(NO_TIME)).alias("time"), "parent", "role")).alias("x")
    once = cut(counted.where("role IS NOT NULL AND msg_key IS NOT NULL").groupBy(*key, "msg_key").agg(least, F.bool_or("said").alias("said")).select(*key, "msg_key", "x.parent", "x.time", "x.role", "said"))
    known = once.select(*key, F.col("msg_key").alias("parent"))
    lost = once.where("parent IS NOT NULL").join(known, [*key, "parent"], "left_anti").select(*key)
    whole = once.join(bad.unionByName(lost).distinct(), key, "left_anti")
    state = cut(whole.select(*key, "msg_key", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("bigint").alias("depth"), F.col("time").alias("latest"), "time", "role", "said"))
    for _ in range(ceil(log2(most)) + 2):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(*key, F.col("msg_key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("latest").alias("l2"))
        step = state.join(above, [*key, "up"], "left")
        state = cut(step.select(
            *key, "msg_key", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.greatest("latest", F.coalesce("l2", "latest")).alias("latest"), "time", "role", "said",
        ))
    circles = state.where("up IS NOT NULL").select(*key).distinct()
    turns = state.where("said AND role IN ('user', 'assistant')").join(circles, key, "left_anti")
    by_time = turns.withColumns({"latest": F.when(oc, F.col("time")).otherwise(F.col("latest")), "depth": F.when(oc, F.lit(0)).otherwise(F.col("depth"))})
    order = ["latest", "depth", "time", "msg_key"]
    kept = by_time.groupBy(*key).agg(F.max_by("role", F.struct(*order)).alias("last"), F.bool_or(F.col("role") == "user").alias("asked"))
    kept = kept.where(F.col("asked") & (F.col("last") == "assistant")).select(*key)
    placed = running_total(by_time.join(kept, key, "left_semi"), key, order, F.lit(1), "place")
    return placed.select(*key, (F.col("place") - 1).alias("pos"), "msg_key", "role")


def rebuild(messages: DataFrame, graph_limit: int = GRAPH_LIMIT) -> DataFrame:
    """``src, session_key, pos, msg_key, role`` of the turns of the kept conversations.

    ``messages``: the columns of :data:`MESSAGE`. A row without a role is no
    message; ``bad`` marks rows that break their conversation. Copies of a
    message count once; a message without a key, with a parent the conversation
    lacks or on a circle breaks its conversation, in source ``oc`` one without
    time or role does too. Only narrow rows move; no text does.
    """
    messages = cut(messages.select(*_NAMES).where("session_key IS NOT NULL"))
    sizes = messages.groupBy("src", "session_key").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > graph_limit))
    most = large.agg(F.max("n")).first()[0]
    small = messages.join(large, ["src", "session_key"], "left_anti") if most else messages
    parted = small.repartition("src", "session_key").sortWithinPartitions("src", "session_key").select(*_NAMES)
    found = parted.mapInArrow(_rebuild, TURNS)
    if not most:
        return found
    hot = messages.join(large.select("src", "session_key"), ["src", "session_key"], "left_semi")
    return found.unionByName(_large_turns(hot, most))


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def role_of(text: Column) -> Column:
    """The role a spelling stands for, blanks and case ignored; null if it is unknown."""
    spelled = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[spelled]


def from_rows(rows: DataFrame) -> DataFrame:
    """Messages of rows (message_id, session_id, role, parts, content, time_created, parent_id), in the columns of :data:`MESSAGE`.

    Rows without a session are in no conversation; a message without an id
    breaks its session, as one with a missing or unknown role, without time or
    with a parent the session lacks does.
    """
    said = F.when(F.col("content").isNotNull(), ~_blank(F.col("content"))).otherwise(
        F.coalesce(F.exists("parts", lambda p: F.coalesce((p["type"] == "text") & ~_blank(p["text"]), F.lit(False))), F.lit(False))
    )
    role = role_of(F.col("role"))
    return rows.where(F.col("session_id").isNotNull()).select(
        F.lit("oc").alias("src"), F.col("session_id").alias("session_key"), F.col("message_id").alias("msg_key"), F.col("parent_id").alias("parent"),
        F.col("time_created").alias("time"), role.alias("role"), said.alias("said"), (role.isNull() | F.col("message_id").isNull()).alias("bad"),
    )


_MAPPING = frozenset([
    "$.conversation_id", "$.id", "$.current_node", "$.mapping.*", "$.mapping.*.parent", "$.mapping.*.message.author.role", "$.mapping.*.message.content.parts[]", "$.mapping.*.message.content.parts[].text",
])


def _branch(found: Found) -> list[tuple[str, str]] | None:
    """(key, role) of the turns from the root to current_node; None if the conversation is broken or incomplete."""
    nodes, current = found.get("$.mapping.*", {}), found.get("$.current_node", {}).get(())
    if current is None or current.kind != "string" or (str(current),) not in nodes:
        return None
    above = {k: str(v) for (k,), v in found.get("$.mapping.*.parent", {}).items() if v.kind != "null"}
    parents = {k: above.get(k) or None for (k,) in nodes}
    _, left = kahn(parents, {})
    if left:
        return None
    parts, texts = found.get("$.mapping.*.message.content.parts[]", {}), found.get("$.mapping.*.message.content.parts[].text", {})
    roles = {k: ROLES.get(str(v).strip().lower()) for (k,), v in found.get("$.mapping.*.message.author.role", {}).items() if v.kind == "string"}
    said = {o[0] for values in (parts, texts) for o, v in values.items() if v.kind == "string" and str(v).strip()}
    path, key = [], str(current)
    while key is not None:
        path.append(key)
        key = parents[key]
    turns = [(k, roles[k]) for k in reversed(path) if k in said and roles.get(k) in ("user", "assistant")]
    return turns if turns and complete([r for _, r in turns]) else None


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plan = plan_of(_MAPPING)
    for batch in batches:
        index, session, turns = [], [], []
        for i, text in enumerate(batch.column(0).to_pylist()):
            for _, found in read_records(text, plan):
                ids = [str(v) for name in ("$.conversation_id", "$.id") if (v := found.get(name, {}).get(())) is not None and v.kind != "null"]
                if key := next(filter(None, ids), None):
                    kept = _branch(found)
                    index.append(i), session.append(key), turns.append(None if kept is None else [{"msg_key": k, "role": r} for k, r in kept])
        take = pa.array(index, pa.int64())
        kind = pa.list_(pa.struct([("msg_key", pa.string()), ("role", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).take(take), batch.column(2).take(take), pa.array(session, pa.string()), pa.array(turns, kind)],
            names=["received_at", "rec_id", "session_key", "turns"],
        )


def from_mappings(exports: DataFrame) -> DataFrame:
    """Conversations of ChatGPT exports (payload, received_at, rec_id): the branch that ends in current_node.

    Of several readable exports of a conversation the last received counts, the
    larger rec_id where both came at once. Parents are checked over the whole
    mapping. A conversation comes whole in one record, so it is ordered there.
    """
    fields = exports.select("payload", "received_at", "rec_id").where(F.col("payload").isNotNull())
    kind = fields.schema["rec_id"].dataType.simpleString()
    found = fields.mapInArrow(_branches, f"received_at timestamp, rec_id {kind}, session_key string, turns array<struct<msg_key: string, role: string>>")
    last = found.groupBy("session_key").agg(F.max_by(F.struct("turns"), F.struct("received_at", "rec_id")).alias("x"))
    turns = last.select("session_key", F.posexplode("x.turns").alias("pos", "t"))
    return turns.select(F.lit("cgpt").alias("src"), "session_key", F.col("pos").cast("bigint").alias("pos"), "t.msg_key", "t.role")


def from_lines(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Messages of JSONL records (source_path, line_no, device, payload); ``zones``: device, zone; in the columns of :data:`MESSAGE`.

    A line without sessionId belongs to the first session its file names. A
    session with an unparseable line in any of its files is broken, as is one
    whose records lack a uuid, name a parent the session lacks or form a circle.
    """
    v = F.col("v")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    body = F.try_variant_get(v, "$.message.content", "variant")
    blocks = F.try_variant_get(v, "$.message.content", "array<variant>")
    string = lambda x: F.schema_of_variant(x) == "STRING"
    block_said = lambda b: F.coalesce(
        (F.try_variant_get(b, "$.type", "string") == "text") & string(F.try_variant_get(b, "$.text", "variant")) & ~_blank(F.try_variant_get(b, "$.text", "string")), F.lit(False)
    )
    said = F.when(string(body), ~_blank(get("$.message.content"))).otherwise(F.coalesce(F.exists(blocks, block_said), F.lit(False)))
    role = F.when(get("$.type").isin("user", "assistant") & ~F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)), get("$.type"))
    read = lines.select("source_path", "line_no", "device", F.try_parse_json("payload").alias("v")).select(
        "source_path", "line_no", "device", v.isNull().alias("unreadable"), F.nullif(get("$.sessionId"), F.lit("")).alias("own"), role.alias("role"),
        get("$.uuid").alias("msg_key"), F.nullif(get("$.parentUuid"), F.lit("")).alias("parent"), get("$.timestamp").alias("ts"), said.alias("said"),
    )
    dated = cut(normalise(read.join(zones, "device", "left"), "ts", "zone", "time").drop("device", "ts", "zone"))
    files = dated.groupBy("source_path").agg(F.min(F.when(F.col("own").isNotNull(), F.struct("line_no", "own"))).alias("first"), F.bool_or("unreadable").alias("bad"))
    named = dated.join(files.select("source_path", F.col("first.own").alias("of_file"), "bad"), "source_path").where("role IS NOT NULL OR bad")
    return named.select(F.lit("jsonl").alias("src"), F.coalesce("own", "of_file").alias("session_key"), "msg_key", "parent", "time", "role", "said", "bad")


def all_conversations(rows: DataFrame, exports: DataFrame, lines: DataFrame, zones: DataFrame, graph_limit: int = GRAPH_LIMIT) -> DataFrame:
    """``src, session_key, pos, msg_key, role`` of the turns of the kept conversations of all three tables."""
    messages = from_rows(rows).unionByName(from_lines(lines, zones))
    return rebuild(messages, graph_limit).unionByName(from_mappings(exports.where(F.lower("source_kind") == "chatgpt")))


def report(turns: DataFrame) -> DataFrame:
    """``src, conversations, turns, alternating``: kept conversations of each source and in how many of them the roles take turns throughout."""
    key = ["src", "session_key"]
    before = turns.select(*key, (F.col("pos") + 1).alias("pos"), F.col("role").alias("was"))
    per = turns.join(before, [*key, "pos"], "left").groupBy(*key).agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("role") == F.col("was"), F.lit(False))).alias("again"))
    return per.groupBy("src").agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.count_if(~F.col("again")).alias("alternating"))
