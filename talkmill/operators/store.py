"""Tables as versioned snapshots, with the writes of the archive and fact layers.

A commit writes new versions of the tables it changes and then switches one
pointer file, so readers see all of it or nothing, and a commit repeated after
a failure leaves no trace of the first attempt.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators import facts as fa
from talkmill.operators import search
from talkmill.schemas import LEDGER, LEDGER_SESSIONS, TABLES

SCHEMA_VERSION = 1
FORGET_ROUNDS, FORGET_FACTS, FORGET_CHUNKS = 20, 20, 10


class Store:
    """Named tables below a folder of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict[str, object]:
        """The newest complete pointer: pointers are numbered files that are renamed into place."""
        folder = self._path(f"{self.home}/commits")
        if not self._fs.exists(folder):
            return {"number": 0, "version": 0, "tables": {}}
        names = [x.getPath().getName() for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit()]
        last = max(map(int, names), default=0)
        if not last:
            return {"number": 0, "version": 0, "tables": {}}
        text = self.spark.read.format("text").option("wholetext", "true").load(f"{self.home}/commits/{last}").first()[0]
        return json.loads(text) | {"number": last}

    def migrate(self) -> int:
        """Create the tables that are missing; the schema's version. Doing it again changes nothing."""
        state = self._pointer()
        missing = {n: self.spark.createDataFrame([], ddl) for n, ddl in TABLES.items() if n not in state["tables"]}
        if missing or state["version"] < SCHEMA_VERSION:
            self.commit(missing)
        return SCHEMA_VERSION

    def read(self, name: str) -> DataFrame:
        state = self._pointer()
        if name not in state["tables"]:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(f"{self.home}/data/{name}/{state['tables'][name]}")

    def commit(self, tables: Mapping[str, DataFrame]) -> int:
        """Replace tables, all or none; the number of the commit. Fails if another commit came in between."""
        state = self._pointer()
        written = {}
        for name, df in tables.items():
            written[name] = uuid.uuid4().hex
            df.write.parquet(f"{self.home}/data/{name}/{written[name]}")
        number = state["number"] + 1
        body = json.dumps({"version": SCHEMA_VERSION, "tables": state["tables"] | written})
        staged, final = self._path(f"{self.home}/staged-{uuid.uuid4().hex}"), self._path(f"{self.home}/commits/{number}")
        out = self._fs.create(staged)
        out.write(bytearray(body, "utf-8"))
        out.close()
        self._fs.mkdirs(self._path(f"{self.home}/commits"))
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"commit {number} was taken")
        return number

    def reset(self, *names: str, confirm: bool = False) -> None:
        """Empty tables, for instance archive and ledger before embedding anew; needs ``confirm``."""
        if not confirm:
            raise ValueError("resetting tables needs confirm=True")
        self.commit({n: self.spark.createDataFrame([], TABLES[n]) for n in names})

    def health(self, dims: int | None = None) -> dict[str, object]:
        """Schema version, rows of each table and whether all dense vectors have ``dims`` elements."""
        state = self._pointer()
        rows = {n: self.read(n).count() for n in TABLES}
        wrong = 0 if dims is None else self.read("archive").where((F.size("dense") != dims) & F.col("dense").isNotNull()).count()
        return {"version": state["version"], "rows": rows, "dims_match": wrong == 0}


def check_dims(df: DataFrame, column: str, dims: int) -> DataFrame:
    """``df``, failing when it is run if a vector has another length."""
    size = F.size(column)
    fault = F.when(F.col(column).isNotNull() & (size != dims), F.raise_error(F.concat(F.lit(f"vector of {dims} expected, got "), size.cast("string"))))
    return df.where(F.coalesce(fault.cast("boolean"), F.lit(True)))


def with_fact_defaults(facts: DataFrame, now: Column) -> DataFrame:
    """New facts with what was left open: an identifier from the statement and time, no entities, full confidence, no provenance, active."""
    have = set(facts.columns)
    or_null = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    h = F.sha2(F.concat_ws("|", "statement", now.cast("string")), 256)
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    span = "array<struct<session_id: string, chunk_id: string>>"
    return facts.select(
        F.coalesce(or_null("id", "string"), made).alias("id"), "statement", F.coalesce(or_null("category", "string"), F.lit("fact")).alias("category"),
        F.coalesce(or_null("entities", "array<string>"), F.array().cast("array<string>")).alias("entities"), F.coalesce(or_null("confidence", "float"), F.lit(1.0)).cast("float").alias("confidence"),
        F.coalesce(or_null("source", "string"), F.lit("user")).alias("source"), F.coalesce(or_null("provenance", span), F.array().cast(span)).alias("provenance"), or_null("project", "string").alias("project"),
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"), now.alias("created_at"), now.alias("updated_at"),
    )


def valid_verdicts(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdicts (new_id, id) that name a candidate of the new fact; others are ignored."""
    return verdicts.dropna().join(candidates.select("new_id", "id").distinct(), ["new_id", "id"], "left_semi")


def remember(facts: DataFrame, new: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """The fact table after adding ``new`` (see :func:`with_fact_defaults`) and superseding what the verdicts (new_id, id) name among its candidates."""
    rows = with_fact_defaults(new, now)
    found = fa.supersede_candidates(facts, rows.withColumnRenamed("id", "new_id"))
    chosen = valid_verdicts(verdicts, found).select("id", F.col("new_id").alias("by_id"))
    return fa.mark_superseded(facts, chosen, now).select(*rows.columns).unionByName(rows)


def record_ingest(ledger: DataFrame, bridge: DataFrame, entries: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger and session bridge with new entries; contents and links already there stay as they are."""
    names = [c.split()[0] for c in LEDGER.split(", ")]
    fresh = entries.dropDuplicates(["content_hash"]).join(ledger.select("content_hash"), "content_hash", "left_anti")
    links = [c.split()[0] for c in LEDGER_SESSIONS.split(", ")]
    return ledger.unionByName(fresh.select(*names)), bridge.select(*links).unionByName(sessions.select(*links)).distinct()


def mark_distilled(ledger: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    hit = done.select("id").distinct().withColumn("__hit", F.lit(True))
    return ledger.join(hit, "id", "left").withColumn("distilled_at", F.when(F.col("__hit"), now).otherwise(F.col("distilled_at"))).drop("__hit")


def forget(facts: DataFrame, chunks: DataFrame, query: str, confirm: bool = False, rounds: int = FORGET_ROUNDS) -> tuple[DataFrame, DataFrame, int]:
    """(facts, chunks, rounds used) without what a query finds, searched again until nothing is left or the rounds are.

    Without ``confirm`` nothing is removed. Lexical search only finds rows that share a word with the query, so unrelated chunks stay.
    """
    used = 0
    while confirm and used < rounds:
        found = search.fulltext(facts, query, limit=FORGET_FACTS).select("id")
        near = search.top(search.sparse_scores(chunks, "chunk_id", query), "chunk_id", FORGET_CHUNKS).select("chunk_id")
        ids, keys = [r[0] for r in found.collect()], [r[0] for r in near.collect()]  # at most 20 and 10
        if not ids and not keys:
            break
        used += 1
        if ids:
            facts = fa.hard_delete(facts, facts.sparkSession.createDataFrame([(i,) for i in ids], "id string"))
        chunks = chunks.where(~F.col("chunk_id").isin(keys)) if keys else chunks
    return facts, chunks, used


def triage(queue: DataFrame, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``id, action`` for the pending queue: duplicates and known statements are rejected, survivors follow the verdicts (id, keep); one without a verdict is kept."""
    judged = fa.triage_duplicates(queue, facts).join(verdicts.groupBy("id").agg(F.bool_and("keep").alias("keep")), "id", "left")
    keep = (F.col("verdict") == "survivor") & F.coalesce("keep", F.lit(True))
    return judged.select("id", F.when(keep, "approve").otherwise("reject").alias("action"))
