"""Queries on facts, review queue, ledger and entities, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.operators import entities as en
from talkmill.operators import facts as fa
from talkmill.operators import incremental, reports, search
from talkmill.operators.archive import with_bounds
from talkmill.plans.prefix import running_total
from talkmill.queries.archive import QUERY, VECTORS, C, chunks, strip_sql
from talkmill.queries.tables import read

NOW = "2026-01-01"
WORDS = '"as agreed" ticket -batch or exporter'
TRANSCRIPT = 48_000

F_ = "f AS (SELECT DISTINCT ON (id) * FROM facts)"
Q_ = "q AS (SELECT DISTINCT ON (id) * FROM review_queue)"
L_ = "l AS (SELECT DISTINCT ON (id) * FROM ingest_ledger)"
M_ = "m AS (SELECT DISTINCT ON (proposal_id) * FROM merge_proposals)"
NORM = "trim(regexp_replace(regexp_replace(lower({}), '\\s+', ' ', 'g'), '[. ]+$', ''))"
FILE = "(regexp_matches({0}, '/|(?i)\\.[a-z]{{1,4}}$') AND NOT regexp_matches({0}, '^[A-Z][A-Za-z0-9]*\\.(js|ts)$'))"
P_ = f"""{Q_}, j AS (SELECT * EXCLUDE proposed_fact, proposed_fact::JSON AS j FROM q WHERE json_valid(proposed_fact)),
    p AS (SELECT id, session_ref, created_at, resolved, {strip_sql("j->>'statement'")} AS statement, j->>'category' AS category,
        CASE WHEN json_type(j, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN greatest(0.0, least(1.0, CAST(j->>'confidence' AS DOUBLE))) ELSE 0.5 END AS confidence,
        list_filter(list_transform(list_filter(coalesce(j->'$.entities[*]', []), lambda e: json_type(e) = 'VARCHAR'), lambda e: e->>'$'), lambda e: NOT {FILE.format('e')}) AS entities,
        CASE WHEN json_type(j, '$.project') = 'VARCHAR' THEN nullif({strip_sql("j->>'project'")}, '') END AS project
        FROM j WHERE json_type(j, '$.statement') = 'VARCHAR' AND json_type(j, '$.category') = 'VARCHAR' AND {strip_sql("j->>'statement'")} <> '' AND j->>'category' IN ('decision', 'preference', 'project', 'person', 'fact'))"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return fa.once(read(spark, folder, "facts"))


def queue(spark: SparkSession, folder: str) -> DataFrame:
    return fa.once(read(spark, folder, "review_queue"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return fa.once(read(spark, folder, "ingest_ledger"))


def _now():
    return F.lit(NOW).cast("timestamp")


def normalize_statement(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).select("id", tx.normalize_statement(F.col("statement")).alias("norm"))


def filename_entities(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.createDataFrame([("src/a.ts",), ("Next.js",), ("notes.md",), ("v1.2",), ("a/b",)], "entity string")
    rows = en.names_of(facts(spark, folder)).unionByName(extra)
    return rows.select("entity", tx.looks_like_file(F.col("entity")).alias("file"))


def validate_proposals(spark: SparkSession, folder: str) -> DataFrame:
    rows = fa.proposals(queue(spark, folder))
    return rows.select("id", "statement", "category", F.round("confidence", 6).alias("confidence"), F.array_join("entities", "|").alias("entities"), "project")


def vault_slug(spark: SparkSession, folder: str) -> DataFrame:
    """Unique file names of entities: the first of those that differ in case only keeps its name."""
    from pyspark.sql import Window

    plain = F.regexp_replace(F.regexp_replace(tx.strip(F.col("entity")), r'[\\/:*?"<>|\x00-\x1f]', "-"), r"[. ]+$", "")
    rows = en.names_of(facts(spark, folder)).select("entity", F.when(plain != "", plain).otherwise("untitled").alias("slug"))
    place = F.row_number().over(Window.partitionBy(F.lower("slug")).orderBy("entity"))
    tail = F.substring(F.lower(F.hex(F.encode("entity", "UTF-8"))), 1, 6)
    return rows.withColumn("n", place).select("entity", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit(" ("), tail, F.lit(")"))).alias("slug"))


def fact_by_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts(spark, folder)
    wanted = rows.agg(F.min("id")).first()[0]
    return rows.where(F.col("id") == wanted).select("id", "statement", "category")


def fact_counts(spark: SparkSession, folder: str) -> DataFrame:
    return fa.fact_counts(facts(spark, folder))


def recent_facts(spark: SparkSession, folder: str) -> DataFrame:
    return fa.recent(facts(spark, folder)).select("id", "statement", F.unix_millis("updated_at").alias("updated_ms"))


def fact_listing(spark: SparkSession, folder: str) -> DataFrame:
    return fa.listing(facts(spark, folder)).select("id", "status", F.unix_millis("created_at").alias("created_ms"))


def superseded_recent(spark: SparkSession, folder: str) -> DataFrame:
    return fa.superseded_recent(facts(spark, folder)).select("id", "statement", "replacement")


def stale_facts(spark: SparkSession, folder: str) -> DataFrame:
    return fa.stale(facts(spark, folder), _now()).select("id", "age_days")


def facts_project_scope(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).where("project = 'harrow' AND category = 'fact'").select("id", "project")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return fa.pending(fa.proposals(queue(spark, folder))).select(F.col("id").alias("new_id"), "category", "entities")


def supersede_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return fa.supersede_candidates(facts(spark, folder), _asked(spark, folder))


def mark_superseded(spark: SparkSession, folder: str) -> DataFrame:
    found = fa.supersede_candidates(facts(spark, folder), _asked(spark, folder)).where("rank = 1")
    rows = fa.mark_superseded(facts(spark, folder), found.select("id", F.col("new_id").alias("by_id")), _now())
    return rows.select("id", "status", "superseded_by", F.unix_millis("updated_at").alias("updated_ms"))


def hard_delete(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts(spark, folder)
    return fa.hard_delete(rows, rows.where("category = 'person'")).select("id", "status", "superseded_by")


def backfill_projects(spark: SparkSession, folder: str) -> DataFrame:
    return fa.backfill_projects(facts(spark, folder), chunks(spark, folder)).select("id", "project")


def fulltext_facts(spark: SparkSession, folder: str) -> DataFrame:
    return search.fulltext(facts(spark, folder), WORDS).select("id", "rank")


def memory_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    found = search.fulltext(facts(spark, folder), WORDS).withColumn("v", F.conv(F.substring("id", 1, 4), 16, 10).cast("bigint") % vectors.count())
    query = vectors.where("vec_id = 0").first()["embedding"]
    rows = search.dense_scores(found.join(vectors, F.col("v") == F.col("vec_id")), "id", query).withColumn("score", F.round("score", 9))
    return search.top(rows, "id", 20).select("id", F.round("score", 6).alias("score"))


def forget_preview(spark: SparkSession, folder: str) -> DataFrame:
    """What forgetting by query would remove: facts and excerpts of chunks. Nothing is removed here."""
    memories = search.fulltext(facts(spark, folder), WORDS, limit=20).select(F.lit("fact").alias("kind"), "id", F.substring("statement", 1, 160).alias("excerpt"))
    scores = search.sparse_scores(chunks(spark, folder), "chunk_id", QUERY).withColumn("score", F.round("score", 9))
    best = search.top(scores, "chunk_id", 10).join(chunks(spark, folder), "chunk_id")
    return memories.unionByName(best.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.substring("text", 1, 160).alias("excerpt")))


def ledger_stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.ledger_stats(ledger(spark, folder))


def ledger_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of the archive that the ledger has already seen, under any status."""
    seen = ledger(spark, folder).select(incremental.clean_hash(F.col("content_hash")).alias("content_hash")).dropna()
    return chunks(spark, folder).select("content_hash").distinct().join(seen, "content_hash", "left_semi")


def undistilled(spark: SparkSession, folder: str) -> DataFrame:
    return reports.undistilled(ledger(spark, folder)).select("id", F.unix_millis("ingested_at").alias("ingested_ms"))


def distill_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of the sessions still to be distilled: their chunks in order, as far as they begin within the first 48,000 characters."""
    todo = incremental.undistilled_contents(read(spark, folder, "ingest_ledger"), read(spark, folder, "distill_runs"))
    rows = with_bounds(chunks(spark, folder)).withColumn("content_hash", incremental.clean_hash(F.col("content_hash"))).join(todo, "content_hash", "left_semi")
    sized = rows.select("session_id", "turn_first", "chunk_id", "text", F.length("text").cast("bigint").alias("n"))
    placed = running_total(sized, ["session_id"], ["turn_first", "chunk_id"], F.col("n"), "upto").where(F.col("upto") - F.col("n") < TRANSCRIPT)
    ordered = F.array_sort(F.collect_list(F.struct("turn_first", "chunk_id", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n")
    return placed.groupBy("session_id").agg(F.count("*").alias("chunks"), F.md5(text).alias("digest"))


def review_pending(spark: SparkSession, folder: str) -> DataFrame:
    rows = fa.pending(queue(spark, folder))
    return rows.orderBy("created_at", "id").limit(100).select("id", F.unix_millis("created_at").alias("created_ms"))


def review_resolve(spark: SparkSession, folder: str) -> DataFrame:
    rows = queue(spark, folder)
    sign = F.substring("id", 1, 1)
    decisions = rows.select("id", F.when(sign < "5", "approve").when(sign < "a", "reject").otherwise("skip").alias("action"))
    return fa.resolve(rows, decisions).select("id", "resolved")


def triage_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return fa.triage_duplicates(queue(spark, folder), facts(spark, folder)).select("id", "verdict")


def triage_batches(spark: SparkSession, folder: str) -> DataFrame:
    return fa.triage_batches(queue(spark, folder), facts(spark, folder))


def triage_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = fa.triage_duplicates(queue(spark, folder), facts(spark, folder))
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return rows.agg(F.count("*").alias("scanned"), count("survivor"), count("duplicate"), count("known"))


def approve_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """The queue's approved proposals as facts, each superseding its newest candidate."""
    accepted = fa.proposals(queue(spark, folder)).where("resolved = 'approved'")
    new, decisions = fa.approve(facts(spark, folder), accepted, F.col("rank") == 1)
    after = fa.mark_superseded(facts(spark, folder), decisions, _now()).select("id", "statement", "status", "superseded_by")
    return after.unionByName(new.select("id", "statement", "status", "superseded_by"))


def memory_stats(spark: SparkSession, folder: str) -> DataFrame:
    counts = fa.fact_counts(facts(spark, folder)).select(F.concat(F.lit("facts_"), "status").alias("name"), F.col("n").alias("value"))
    stats = reports.ledger_stats(ledger(spark, folder))
    flat = stats.select(F.explode(F.array(*[F.struct(F.lit(f"ledger_{c}").alias("name"), F.col(c).alias("value")) for c in stats.columns])).alias("x")).select("x.*")
    waiting = fa.pending(queue(spark, folder)).agg(F.count("*").alias("value")).select(F.lit("pending").alias("name"), "value")
    stored = chunks(spark, folder).agg(F.count("*").alias("value")).select(F.lit("archive").alias("name"), "value")
    return counts.unionByName(flat).unionByName(waiting).unionByName(stored)


def entity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return en.entity_pairs(en.names_of(facts(spark, folder)))


def entity_groups(spark: SparkSession, folder: str) -> DataFrame:
    return en.group_by_label(entity_pairs(spark, folder))


def entity_samples(spark: SparkSession, folder: str) -> DataFrame:
    return en.entity_samples(facts(spark, folder))


def validate_merges(spark: SparkSession, folder: str) -> DataFrame:
    merges = read(spark, folder, "merge_proposals")
    return en.valid_merges(merges, en.names_of(facts(spark, folder))).select("proposal_id", "canonical", F.array_join("members", "|").alias("members"))


def apply_entity_merges(spark: SparkSession, folder: str) -> DataFrame:
    alias = en.aliases(read(spark, folder, "merge_proposals").dropDuplicates(["proposal_id"]))
    rows = en.apply_merges(facts(spark, folder), alias, _now())
    return rows.select("id", F.array_join("entities", "|").alias("entities"), F.unix_millis("updated_at").alias("updated_ms"))


def entity_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return en.cooccurrence(facts(spark, folder))


def top_entities(spark: SparkSession, folder: str) -> DataFrame:
    return en.top_entities(facts(spark, folder))


def vault_category(spark: SparkSession, folder: str) -> DataFrame:
    return reports.vault_category(facts(spark, folder))


def vault_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.vault_lines(facts(spark, folder)).select("page", "line")


def vault_entity(spark: SparkSession, folder: str) -> DataFrame:
    return reports.vault_entity(facts(spark, folder))


def daily_log(spark: SparkSession, folder: str) -> DataFrame:
    return reports.daily_log(facts(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_statement, filename_entities, validate_proposals, vault_slug, fact_by_id, fact_counts, recent_facts, fact_listing, superseded_recent, stale_facts, facts_project_scope,
        supersede_candidates, mark_superseded, hard_delete, backfill_projects, fulltext_facts, memory_search, forget_preview, ledger_stats, ledger_skip, undistilled, distill_transcripts,
        review_pending, review_resolve, triage_duplicates, triage_batches, triage_report, approve_proposals, memory_stats, entity_pairs, entity_groups, entity_samples,
        validate_merges, apply_entity_merges, entity_cooccurrence, top_entities, vault_category, vault_lines, vault_entity, daily_log,
    )
}

_SUP = f"""{F_}, {P_}, a AS (SELECT DISTINCT p.id AS new_id, p.category, x.e AS entity FROM p, unnest(p.entities) AS x(e) WHERE resolved IS NULL),
    k AS (SELECT DISTINCT f.id, f.category, f.created_at, x.e AS entity FROM f, unnest(f.entities) AS x(e) WHERE status = 'active'),
    s AS (SELECT DISTINCT new_id, id, created_at FROM a JOIN k USING (category, entity) WHERE new_id <> id),
    r AS (SELECT new_id, id, row_number() OVER (PARTITION BY new_id ORDER BY created_at DESC, id) AS rank FROM s)"""
_TRI = f"""{F_}, {P_}, n AS (SELECT id, created_at, {NORM.format('statement')} AS norm FROM p WHERE resolved IS NULL),
    k AS (SELECT DISTINCT {NORM.format('statement')} AS norm FROM f WHERE status = 'active'),
    v AS (SELECT id, created_at, CASE WHEN norm IN (SELECT norm FROM k) THEN 'known' WHEN row_number() OVER (PARTITION BY norm ORDER BY created_at, id) > 1 THEN 'duplicate' ELSE 'survivor' END AS verdict FROM n)"""
_FTS = f"""{F_}, x AS (SELECT *, regexp_split_to_array(lower(statement), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM f WHERE status = 'active'),
    y AS (SELECT *, len(list_filter(w, lambda z: z IN ('as', 'agreed', 'ticket', 'exporter'))) AS rank FROM x
        WHERE (contains(' ' || array_to_string(w, ' ') || ' ', ' as agreed ') AND list_contains(w, 'ticket') AND NOT list_contains(w, 'batch')) OR list_contains(w, 'exporter'))"""
_STATS = f"""{L_}, g AS (SELECT count(*) AS files, coalesce(sum(sessions), 0)::BIGINT AS sessions, coalesce(sum(chunks), 0)::BIGINT AS chunks, coalesce(sum(secrets_found), 0)::BIGINT AS secrets_found, epoch_ms(max(ingested_at)) AS last_ingest_ms FROM l WHERE status = 'ingested')"""
_NAMES = f"{F_}, e AS (SELECT DISTINCT x.e AS entity FROM f, unnest(entities) AS x(e) WHERE x.e IS NOT NULL)"
_PAIRS = f"""{_NAMES}, z AS (SELECT entity, regexp_replace(lower(entity), '[^a-z0-9]', '', 'g') AS form FROM e),
    pr AS (SELECT DISTINCT least(a.entity, b.entity) AS a, greatest(a.entity, b.entity) AS b FROM z a JOIN z b ON a.entity <> b.entity AND starts_with(b.form, a.form) AND length(a.form) >= 3 AND length(a.form) >= length(b.form) * 0.3)"""
_ALIAS = f"{M_}, al AS (SELECT x.n AS name, arg_min(canonical, proposal_id) AS t FROM m, unnest(members) AS x(n) WHERE x.n IS NOT NULL AND x.n <> canonical GROUP BY x.n)"

_OBJECTIONS = "'(?i)" + "|".join(en.CONTRADICTIONS).replace("'", "''") + "'"

SQL = {
    "normalize_statement": f"WITH {F_} SELECT id, {NORM.format('statement')} AS norm FROM f",
    "filename_entities": f"WITH {_NAMES} SELECT entity, {FILE.format('entity')} AS file FROM (SELECT entity FROM e UNION ALL SELECT unnest(['src/a.ts', 'Next.js', 'notes.md', 'v1.2', 'a/b']))",
    "validate_proposals": f"WITH {P_} SELECT id, statement, category, round(confidence, 6) AS confidence, array_to_string(entities, '|') AS entities, project FROM p",
    "vault_slug": f"""WITH {_NAMES}, s AS (SELECT entity, coalesce(nullif(regexp_replace(regexp_replace({strip_sql('entity')}, '[\\\\/:*?"<>|\\x00-\\x1f]', '-', 'g'), '[. ]+$', ''), ''), 'untitled') AS slug FROM e)
        SELECT entity, CASE WHEN row_number() OVER (PARTITION BY lower(slug) ORDER BY entity) = 1 THEN slug ELSE slug || ' (' || lower(hex(entity))[1:6] || ')' END AS slug FROM s""",
    "fact_by_id": f"WITH {F_} SELECT id, statement, category FROM f WHERE id = (SELECT min(id) FROM f)",
    "fact_counts": f"WITH {F_} SELECT s AS status, count(id) AS n FROM (SELECT unnest(['active', 'superseded', 'deleted']) AS s) LEFT JOIN f ON status = s GROUP BY s",
    "recent_facts": f"WITH {F_} SELECT id, statement, epoch_ms(updated_at) AS updated_ms FROM f ORDER BY updated_at DESC, id LIMIT 50",
    "fact_listing": f"WITH {F_} SELECT id, status, epoch_ms(created_at) AS created_ms FROM f ORDER BY created_at, id LIMIT 10000",
    "superseded_recent": f"WITH {F_}, g AS (SELECT * FROM f WHERE status = 'superseded' ORDER BY updated_at DESC, id LIMIT 20) SELECT g.id, g.statement, f.statement AS replacement FROM g LEFT JOIN f ON f.id = g.superseded_by",
    "stale_facts": f"WITH {F_} SELECT id, floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(updated_at)) / 86400000)::BIGINT AS age_days FROM f WHERE status = 'active' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 3 MONTH",
    "facts_project_scope": f"WITH {F_} SELECT id, project FROM f WHERE project = 'harrow' AND category = 'fact'",
    "supersede_candidates": f"WITH {_SUP} SELECT new_id, id, rank FROM r WHERE rank <= 20",
    "mark_superseded": f"""WITH {_SUP}, d AS (SELECT id, min(new_id) AS by_id FROM r WHERE rank = 1 GROUP BY id)
        SELECT f.id, CASE WHEN status = 'active' AND by_id IS NOT NULL THEN 'superseded' ELSE status END AS status, CASE WHEN status = 'active' AND by_id IS NOT NULL THEN by_id ELSE superseded_by END AS superseded_by,
            CASE WHEN status = 'active' AND by_id IS NOT NULL THEN epoch_ms(TIMESTAMP '{NOW}') ELSE epoch_ms(updated_at) END AS updated_ms FROM f LEFT JOIN d USING (id)""",
    "hard_delete": f"WITH {F_}, g AS (SELECT id FROM f WHERE category = 'person') SELECT id, status, CASE WHEN superseded_by IN (SELECT id FROM g) THEN NULL ELSE superseded_by END AS superseded_by FROM f WHERE id NOT IN (SELECT id FROM g)",
    "backfill_projects": f"""WITH {F_}, {C}, s AS (SELECT session_id, arg_min(project, (turn_first, chunk_id)) AS found FROM c WHERE project <> '' GROUP BY session_id),
        o AS (SELECT id, i, provenance[i].session_id AS session_id FROM (SELECT id, provenance, unnest(range(1, len(provenance) + 1)) AS i FROM f WHERE project IS NULL)),
        b AS (SELECT id, arg_min(found, i) AS found FROM o JOIN s USING (session_id) GROUP BY id) SELECT id, coalesce(project, found) AS project FROM f LEFT JOIN b USING (id)""",
    "fulltext_facts": f"WITH {_FTS} SELECT id, rank FROM y ORDER BY rank DESC, id LIMIT 50",
    "memory_search": f"""WITH {_FTS}, z AS (SELECT id, ('0x' || id[1:4])::BIGINT % (SELECT count(*) FROM embeddings) AS v FROM y ORDER BY rank DESC, id LIMIT 50),
        s AS (SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM z JOIN embeddings ON v = vec_id)
        SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20""",
    "forget_preview": f"""WITH {_FTS}, {VECTORS.strip()}, b AS (SELECT chunk_id FROM s ORDER BY score DESC, chunk_id LIMIT 10)
        SELECT 'fact' AS kind, id, statement[1:160] AS excerpt FROM (SELECT * FROM y ORDER BY rank DESC, id LIMIT 20) UNION ALL SELECT 'chunk', chunk_id::VARCHAR, text[1:160] FROM c JOIN b USING (chunk_id)""",
    "distill_transcripts": f"""WITH {C}, g AS (SELECT regexp_extract(lower(content_hash), '^\\s*(?:[a-z0-9_-]+:)?\\s*([0-9a-f]{{64}})\\s*$', 1) AS h, status, distilled_at FROM ingest_ledger),
        todo AS (SELECT h FROM g WHERE h <> '' AND status = 'ingested' AND h NOT IN (SELECT g.h FROM g JOIN distill_runs r ON r.outcome = 'ok' AND g.distilled_at BETWEEN r.started_at AND r.ended_at)),
        n AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn_first, chunk_id) - length(text) AS begins FROM c WHERE lower(trim(content_hash)) IN (SELECT h FROM todo))
        SELECT session_id, count(*) AS chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn_first, chunk_id)) AS digest FROM n WHERE begins < 48000 GROUP BY session_id""",
    "approve_proposals": f"""WITH {F_}, {P_}, n AS (SELECT * FROM p WHERE resolved = 'approved'), a AS (SELECT DISTINCT n.id AS new_id, n.category, x.e AS entity FROM n, unnest(n.entities) AS x(e)),
        k AS (SELECT DISTINCT f.id, f.category, f.created_at, x.e AS entity FROM f, unnest(f.entities) AS x(e) WHERE status = 'active'),
        s AS (SELECT DISTINCT new_id, id, created_at FROM a JOIN k USING (category, entity) WHERE new_id <> id),
        d AS (SELECT id, min(new_id) AS by_id FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY created_at DESC, id) AS r FROM s) WHERE r = 1 GROUP BY id)
        SELECT f.id, statement, CASE WHEN status = 'active' AND by_id IS NOT NULL THEN 'superseded' ELSE status END AS status, CASE WHEN status = 'active' AND by_id IS NOT NULL THEN by_id ELSE superseded_by END AS superseded_by FROM f LEFT JOIN d USING (id)
        UNION ALL SELECT id, statement, 'active', NULL FROM n""",
    "ledger_stats": f"WITH {_STATS} SELECT * FROM g",
    "ledger_skip": "SELECT DISTINCT lower(trim(content_hash)) AS content_hash FROM chunks WHERE lower(trim(content_hash)) IN (SELECT regexp_extract(lower(content_hash), '^\\s*(?:[a-z0-9_-]+:)?\\s*([0-9a-f]{64})\\s*$', 1) FROM ingest_ledger)",
    "undistilled": f"WITH {L_} SELECT id, epoch_ms(ingested_at) AS ingested_ms FROM l WHERE status = 'ingested' AND distilled_at IS NULL",
    "review_pending": f"WITH {Q_} SELECT id, epoch_ms(created_at) AS created_ms FROM q WHERE resolved IS NULL ORDER BY created_at, id LIMIT 100",
    "review_resolve": f"WITH {Q_} SELECT id, coalesce(resolved, CASE WHEN id[1:1] < '5' THEN 'approved' WHEN id[1:1] < 'a' THEN 'rejected' END) AS resolved FROM q",
    "triage_duplicates": f"WITH {_TRI} SELECT id, verdict FROM v",
    "triage_batches": f"WITH {_TRI}, o AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS n FROM v WHERE verdict = 'survivor') SELECT id, (n // 25)::BIGINT AS batch, n % 25 AS place FROM o",
    "triage_report": f"WITH {_TRI} SELECT count(*) AS scanned, count(*) FILTER (WHERE verdict = 'survivor') AS survivor, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicate, count(*) FILTER (WHERE verdict = 'known') AS known FROM v",
    "memory_stats": f"""WITH {F_}, {Q_}, {C}, {_STATS} SELECT 'facts_' || s AS name, count(id) AS value FROM (SELECT unnest(['active', 'superseded', 'deleted']) AS s) LEFT JOIN f ON status = s GROUP BY s
        UNION ALL SELECT 'ledger_' || name, value FROM (UNPIVOT g ON COLUMNS(*)) UNION ALL SELECT 'pending', count(*) FROM q WHERE resolved IS NULL UNION ALL SELECT 'archive', count(*) FROM c""",
    "entity_pairs": f"WITH {_PAIRS} SELECT a, b FROM pr",
    "entity_groups": f"""WITH RECURSIVE {_PAIRS}, u AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n WHERE r.m < u.b)
        SELECT n AS entity, min(m) AS group_key FROM r GROUP BY n""",
    "entity_samples": f"""WITH {F_}, x AS (SELECT DISTINCT f.id, created_at, statement, x.e AS entity FROM f, unnest(entities) AS x(e) WHERE status = 'active'), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id) AS n FROM x)
        SELECT entity, count(*) AS facts, string_agg(statement, ' | ' ORDER BY n) FILTER (WHERE n <= 3) AS samples FROM n GROUP BY entity""",
    "validate_merges": f"""WITH RECURSIVE {_NAMES}, {M_}, v AS (SELECT proposal_id, canonical, x.n AS member FROM m, unnest(list_distinct(members)) AS x(n) WHERE canonical IS NOT NULL AND NOT regexp_matches(coalesce(reason, ''), {_OBJECTIONS}) AND x.n IN (SELECT entity FROM e)),
        g AS (SELECT proposal_id, canonical, list_sort(list(member)) AS members FROM v GROUP BY ALL HAVING count(*) >= 2 AND bool_or(member = canonical)),
        o AS (SELECT *, row_number() OVER (ORDER BY proposal_id) AS i FROM g),
        w(i, taken, claimed) AS (SELECT 0::BIGINT, false, []::VARCHAR[] UNION ALL SELECT o.i, NOT list_has_any(o.members, claimed), CASE WHEN list_has_any(o.members, claimed) THEN claimed ELSE list_concat(claimed, o.members) END FROM w JOIN o ON o.i = w.i + 1)
        SELECT proposal_id, canonical, array_to_string(members, '|') AS members FROM o JOIN w USING (i) WHERE taken""",
    "apply_entity_merges": f"""WITH {F_}, {_ALIAS}, x AS (SELECT f.id, list_sort(list(DISTINCT coalesce(t, x.e))) AS n, bool_or(t IS NOT NULL) AS hit FROM f, unnest(entities) AS x(e) LEFT JOIN al ON al.name = x.e GROUP BY f.id)
        SELECT f.id, array_to_string(CASE WHEN hit THEN n ELSE entities END, '|') AS entities, CASE WHEN hit THEN epoch_ms(TIMESTAMP '{NOW}') ELSE epoch_ms(updated_at) END AS updated_ms FROM f LEFT JOIN x USING (id)""",
    "entity_cooccurrence": f"""WITH {F_}, x AS (SELECT DISTINCT f.id, x.e FROM f, unnest(entities) AS x(e) WHERE status = 'active') SELECT a.e AS a, b.e AS b, count(*) AS facts FROM x a JOIN x b ON a.id = b.id AND a.e < b.e GROUP BY ALL HAVING count(*) >= 2""",
    "top_entities": f"WITH {F_} SELECT x.e AS entity, count(*) AS facts FROM f, unnest(entities) AS x(e) WHERE status = 'active' GROUP BY x.e ORDER BY facts DESC, entity LIMIT 40",
    "vault_category": f"WITH {F_} SELECT category, count(*) AS lines FROM f WHERE status = 'active' GROUP BY category",
    "vault_lines": f"""WITH {F_} SELECT category || '.md' AS page, '- ' || statement || CASE WHEN len(entities) > 0 THEN ' _(' || array_to_string(entities, ', ') || ')_' ELSE '' END || ' <!-- fact:' || id || ' source:' || source || ' -->' AS line FROM f WHERE status = 'active'""",
    "vault_entity": f"WITH {F_} SELECT x.e AS entity, category, count(*) AS facts FROM f, unnest(entities) AS x(e) WHERE status = 'active' GROUP BY ALL",
    "daily_log": f"""WITH {F_}, a AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM f GROUP BY 1), b AS (SELECT strftime(updated_at, '%Y-%m-%d') AS day, count(*) AS n FROM f WHERE status = 'superseded' GROUP BY 1)
        SELECT day, coalesce(a.n, 0) AS learned, coalesce(b.n, 0) AS superseded FROM a FULL JOIN b USING (day)""",
}
