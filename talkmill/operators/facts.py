"""The semantic layer: facts, their review queue and supersede chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import blank_to_null, looks_like_file, normalize_statement, strip
from talkmill.operators.archive import with_bounds

CATEGORIES = ("decision", "preference", "project", "person", "fact")
STATUSES = ("active", "superseded", "deleted")
TRIAGE_BATCH = 25
CANDIDATES = 20
LISTED = 10_000
PROPOSAL = "statement string, category string, entities array<variant>, confidence variant, project string"


def once(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice count once."""
    return rows.dropDuplicates([key])


def fact_counts(facts: DataFrame) -> DataFrame:
    """``status, n`` of every status, 0 where there is none."""
    names = facts.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = facts.groupBy("status").agg(F.count("*").alias("n"))
    return names.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def recent(facts: DataFrame, limit: int = 50) -> DataFrame:
    return facts.orderBy(F.desc("updated_at"), "id").limit(limit)


def listing(facts: DataFrame, limit: int = LISTED) -> DataFrame:
    """All facts of any status in order of creation, at most ``limit``: a listing for people, not a way to read the table."""
    return facts.orderBy("created_at", "id").limit(limit)


def superseded_recent(facts: DataFrame, limit: int = 20) -> DataFrame:
    """Superseded facts, newest first, with the statement that replaced each."""
    gone = facts.where(F.col("status") == "superseded").orderBy(F.desc("updated_at"), "id").limit(limit)
    by = facts.select(F.col("id").alias("superseded_by"), F.col("statement").alias("replacement"))
    return gone.join(by, "superseded_by", "left")


def age_days(at: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(now) - F.unix_millis(at)) / 86_400_000)


def stale(facts: DataFrame, now: Column, months: int = 3) -> DataFrame:
    """Active facts not updated for ``months``, oldest first."""
    since = now - F.make_ym_interval(F.lit(0), F.lit(months))
    rows = facts.where((F.col("status") == "active") & (F.col("updated_at") < since))
    return rows.withColumn("age_days", age_days(F.col("updated_at"), now)).orderBy("updated_at", "id")


def supersede_candidates(facts: DataFrame, new: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """``new_id, id, rank``: active facts of the same category that share an entity with a new statement, newest first.

    ``new``: new_id, category, entities. Of each (category, entity) only the
    newest ``limit`` + 1 facts can be among the newest of a statement, so no more
    are joined: an entity that many facts and statements share forms no square.
    """
    asked = new.select("new_id", "category", F.explode(F.array_distinct("entities")).alias("entity"))
    known = facts.where(F.col("status") == "active").select("id", "category", "created_at", F.explode(F.array_distinct("entities")).alias("entity"))
    newest = F.row_number().over(Window.partitionBy("category", "entity").orderBy(F.desc("created_at"), "id"))
    few = known.withColumn("__n", newest).where(F.col("__n") <= limit + 1).drop("__n")
    pairs = asked.join(few, ["category", "entity"]).where("new_id <> id").select("new_id", "id", "created_at").distinct()
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("created_at"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("new_id", "id", "rank")


def mark_superseded(facts: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Facts with the decisions (id, by_id) applied to those still active."""
    first = decisions.groupBy("id").agg(F.min("by_id").alias("by_id"))
    hit = (F.col("status") == "active") & F.col("by_id").isNotNull()
    rows = facts.join(first, "id", "left")
    return rows.withColumns({
        "superseded_by": F.when(hit, F.col("by_id")).otherwise(F.col("superseded_by")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "status": F.when(hit, "superseded").otherwise(F.col("status")),
    }).drop("by_id")


def hard_delete(facts: DataFrame, doomed: DataFrame) -> DataFrame:
    """Facts without the ids of ``doomed``; pointers to them become null, the pointing rows keep their status."""
    gone = doomed.select("id").distinct()
    left = facts.join(gone, "id", "left_anti")
    pointed = gone.select(F.col("id").alias("superseded_by"), F.lit(True).alias("lost"))
    return left.join(pointed, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("lost").isNull(), F.col("superseded_by"))).drop("lost")


def session_projects(chunks: DataFrame) -> DataFrame:
    """``session_id, found``: the first non-empty project of each session."""
    rows = with_bounds(chunks).where("project <> ''")
    return rows.groupBy("session_id").agg(F.min_by("project", F.struct("turn_first", "chunk_id")).alias("found"))


def backfill_projects(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with a project from the first of their sessions that has one, where they had none."""
    open_ = facts.where("project IS NULL AND size(provenance) > 0").select("id", F.posexplode("provenance").alias("at", "p"))
    met = open_.select("id", "at", F.col("p.session_id").alias("session_id")).join(session_projects(chunks), "session_id")
    first = met.groupBy("id").agg(F.min_by("found", "at").alias("found"))
    return facts.join(first, "id", "left").withColumn("project", F.coalesce("project", "found")).drop("found")


def proposals(queue: DataFrame) -> DataFrame:
    """Valid proposals of a review queue: trimmed statement, known category, confidence within [0, 1] (0.5 if it is no number), entities that are no files, trimmed project."""
    v = F.try_parse_json("proposed_fact")
    text = lambda p: F.try_variant_get(v, p, "string")
    is_string = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING"
    number = F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant")).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT|INT")
    confidence = F.when(number, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get(v, "$.confidence", "double")))).otherwise(F.lit(0.5))
    parts = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), F.array().cast("array<variant>"))
    names = F.transform(F.filter(parts, lambda e: F.schema_of_variant(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string"))
    rows = queue.select(
        "id", "session_ref", "created_at", "resolved", F.when(is_string("$.statement"), strip(text("$.statement"))).alias("statement"),
        F.when(is_string("$.category"), text("$.category")).alias("category"), confidence.alias("confidence"),
        F.filter(names, lambda e: ~looks_like_file(e)).alias("entities"), F.when(is_string("$.project"), blank_to_null(strip(text("$.project")))).alias("project"),
    )
    return rows.where((F.col("statement") != "") & F.col("category").isin(*CATEGORIES))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("resolved IS NULL")


def triage_duplicates(queue: DataFrame, facts: DataFrame) -> DataFrame:
    """``id, verdict`` of pending proposals: ``survivor``, ``duplicate`` of an earlier one or ``known`` as an active fact. Statements are compared in normal form."""
    norm = normalize_statement(F.col("statement")).alias("norm")
    rows = pending(proposals(queue)).select("id", "created_at", norm)
    first = rows.groupBy("norm").agg(F.min(F.struct("created_at", "id")).alias("first")).select("norm", F.col("first.id").alias("first_id"))
    active = facts.where(F.col("status") == "active").select(norm, F.lit(True).alias("known")).distinct()
    judged = rows.join(first, "norm").join(active, "norm", "left")
    verdict = F.when(F.col("known"), "known").when(F.col("id") != F.col("first_id"), "duplicate").otherwise("survivor")
    return judged.select("id", "created_at", verdict.alias("verdict"))


def triage_batches(queue: DataFrame, facts: DataFrame) -> DataFrame:
    """``id, batch, place`` of the survivors in order of arrival, 25 a batch.

    The position is counted over a range-partitioned order, not in one task.
    """
    from talkmill.plans.prefix import running_total

    rows = triage_duplicates(queue, facts).where("verdict = 'survivor'").select("id", "created_at")
    placed = running_total(rows, [], ["created_at", "id"], F.lit(1), "n")
    at = F.col("n") - 1
    return placed.select("id", F.floor(at / TRIAGE_BATCH).alias("batch"), (at % TRIAGE_BATCH).alias("place"))


def resolve(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue with decisions (id, action) applied to rows still pending; ``approve`` and ``reject`` count, others leave a row as it is."""
    first = decisions.where(F.col("action").isin("approve", "reject")).groupBy("id").agg(F.min("action").alias("action"))
    state = F.when(F.col("resolved").isNull() & (F.col("action") == "approve"), "approved").when(F.col("resolved").isNull() & (F.col("action") == "reject"), "rejected")
    return queue.join(first, "id", "left").withColumn("resolved", F.coalesce(state, F.col("resolved"))).drop("action")


def approve(facts: DataFrame, accepted: DataFrame, judge: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new facts of accepted proposals, decisions on what they supersede).

    ``judge`` says of a candidate row (new_id, id, rank) whether it is superseded; without one nothing is.
    """
    new = accepted.select(
        "id", "statement", "category", "entities", "confidence", F.lit("distilled").alias("source"),
        F.array(F.struct(F.col("session_ref").alias("session_id"), F.lit(None).cast("string").alias("chunk_id"))).alias("provenance"),
        "project", F.lit("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"), "created_at", F.col("created_at").alias("updated_at"),
    )
    found = supersede_candidates(facts, new.withColumnRenamed("id", "new_id"))
    kept = found.where(judge if judge is not None else F.lit(False))
    return new, kept.select("id", F.col("new_id").alias("by_id"))
