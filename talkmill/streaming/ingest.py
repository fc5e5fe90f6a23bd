"""Ingest of an inbox: once per content, in batch or as a stream that ends when nothing is new.

Each batch is hashed, anti-joined with the ledger, parsed, redacted, chunked,
embedded and written under its batch id; the ledger row is written last. A batch
that is repeated after a failure overwrites its own parts and nothing else. A
session that is exported again comes whole in a later batch and replaces itself:
:func:`read_archive` gives the rows that hold. Files whose vectors failed leave
nothing behind and are tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.text import point_id, redact
from talkmill.operators import search
from talkmill.operators.archive import latest_sessions
from talkmill.operators.chunking import chunk_sessions
from talkmill.operators.services import embed
from talkmill.plans.lineage import cut
from talkmill.schemas import ARCHIVE, LEDGER
from talkmill.sources.parsers import detect, from_files, parse_all

#: Rewrites ``text`` and adds ``found``, the number of replacements.
Redactor = Callable[[DataFrame], DataFrame]
#: Vectors of texts, and their length.
Embedder = tuple[Callable[[list[str]], list[list[float]]], int]


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose content no ledger row of any status has, one per content, with ``content_hash``."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    first = hashed.groupBy("content_hash").agg(F.min("path").alias("path"))
    return hashed.join(first, ["content_hash", "path"]).join(ledger.select("content_hash").distinct(), "content_hash", "left_anti")


def ingest(files: DataFrame, ledger: DataFrame, redactor: Redactor = redact, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archive rows, ledger rows, disposition of every file) of a set of files ``path, device, content``.

    Files of no known kind and those that give no turn are quarantined. Of
    several files with the same session the last by path counts for it. Without
    an embedder vectors are null; a file one of whose vectors failed has state
    ``failed``, stays in the inbox and gives neither archive nor ledger rows.
    """
    fresh = new_files(files, ledger)
    turns = parse_all(fresh.select("path", "device", "content"))
    clean = cut(redactor(turns))  # each file is parsed and redacted once
    last = clean.groupBy("session_id").agg(F.max("path").alias("path"))
    kept = clean.join(last, ["session_id", "path"], "left_semi")
    sessions = kept.groupBy("session_id").agg(*[F.first(c).alias(c) for c in ("path", "source_tool", "device", "project", "started_at")])
    chunks = chunk_sessions(kept).join(sessions, "session_id").join(fresh.select("path", "content_hash"), "path")
    points = cut(chunks.select(
        point_id(F.col("session_id"), F.col("chunk_index")).alias("point_id"), "session_id", "source_tool", "device", "project", F.col("started_at").alias("ts"), "turn_range", "text", "content_hash", "path",
    ))
    if embedder is None:
        archive = points.withColumn("dense", F.lit(None).cast("array<float>"))
        failed = points.select("path").limit(0)
    else:
        vectors = cut(embed(points, "point_id", "text", *embedder, keep_errors=True))
        failed = cut(points.join(vectors.where("error IS NOT NULL"), "point_id").select("path").distinct())
        archive = points.join(failed, "path", "left_anti").join(vectors.select("point_id", "dense"), "point_id")
    per_turns = clean.groupBy("path").agg(F.countDistinct("session_id").cast("int").alias("sessions"), F.sum("found").cast("int").alias("secrets_found"))
    per_chunks = points.groupBy("path").agg(F.count("*").cast("int").alias("chunks"))
    rows = fresh.join(failed, "path", "left_anti").join(per_turns, "path", "left").join(per_chunks, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    entries = rows.select(
        F.sha2(F.concat(F.lit("ledger:"), "content_hash"), 256).alias("id"), F.col("path").alias("source_path"), F.coalesce(detect(F.col("path"), F.col("content")), F.lit("unknown")).alias("source_kind"), "content_hash",
        zero("sessions"), zero("chunks"), zero("secrets_found"), F.when(F.col("sessions").isNull(), "quarantined").otherwise("ingested").alias("status"),
        F.lit(None).cast("timestamp").alias("distilled_at"), F.current_timestamp().alias("ingested_at"),
    )
    known = entries.select(F.col("source_path").alias("path"), "status").unionByName(failed.withColumn("status", F.lit("failed")))
    state = files.join(known, "path", "left").select("path", F.coalesce("status", F.lit("skipped")).alias("status"))
    place = F.when(F.col("status") == "quarantined", "quarantine").when(F.col("status") == "failed", "inbox").otherwise("archive")
    return archive.select(*[c.split()[0] for c in ARCHIVE.split(", ")]), entries, state.withColumn("disposition", place)


def _parts(spark: SparkSession, folder: str, without: str = "") -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []
    return [f"{folder}/{n}" for n in names if n.startswith("batch_id=") and n != without]


def read_archive(spark: SparkSession, home: str) -> DataFrame:
    """The archive: of each session the rows of the last batch that holds it, with their ``batch_id``."""
    parts = _parts(spark, f"{home}/archive")
    if not parts:
        return spark.createDataFrame([], f"{ARCHIVE}, batch_id bigint")
    rows = spark.read.schema(f"{ARCHIVE}, batch_id bigint").option("basePath", f"{home}/archive").parquet(*parts)
    return latest_sessions(rows)


def read_postings(spark: SparkSession, home: str) -> DataFrame:
    """``point_id, token_id, n`` of the rows of :func:`read_archive`, for :func:`search.search_postings`."""
    parts = _parts(spark, f"{home}/postings")
    if not parts:
        return spark.createDataFrame([], "point_id string, token_id bigint, n bigint")
    rows = spark.read.schema("point_id string, token_id bigint, n bigint, batch_id bigint").option("basePath", f"{home}/postings").parquet(*parts)
    return rows.join(read_archive(spark, home).select("point_id", "batch_id"), ["point_id", "batch_id"], "left_semi").drop("batch_id")


def read_ledger(spark: SparkSession, home: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{home}/ledger/batch_id=*")


def stream_inbox(spark: SparkSession, inbox: str, home: str, redactor: Redactor = redact, embedder: Embedder | None = None) -> None:
    """Ingest everything new below ``<inbox>/<device>/`` into ``<home>/archive``, ``postings`` and ``ledger``, then stop.

    Files that failed in an earlier run come along with the first new ones, or alone if nothing is new.
    """

    def batch(files: DataFrame, number: int) -> None:
        """Under number 2n the n-th batch of the stream, under 2n + 1 what is tried again after it."""
        name = f"batch_id={number:012}"
        earlier = _parts(spark, f"{home}/ledger", name)
        ledger = spark.read.schema(LEDGER).parquet(*earlier) if earlier else spark.createDataFrame([], LEDGER)
        archive, entries, state = ingest(from_files(files, inbox), ledger, redactor, embedder)
        archive = cut(archive)
        archive.write.mode("overwrite").parquet(f"{home}/archive/{name}")
        search.postings(archive, "point_id").write.mode("overwrite").parquet(f"{home}/postings/{name}")
        cut(state).where("status = 'failed'").write.mode("overwrite").parquet(f"{home}/failed/{name}")
        entries.write.mode("overwrite").parquet(f"{home}/ledger/{name}")

    def again() -> None:
        parts = _parts(spark, f"{home}/failed")
        if not parts:
            return
        done = read_ledger(spark, home).select(F.col("source_path").alias("path"))
        failed = spark.read.schema("path string, status string, disposition string").parquet(*parts).select("path").distinct()
        paths = [r["path"] for r in failed.join(done, "path", "left_anti").toLocalIterator()]  # handed to the reader, which lists them on the driver in any case
        if paths:
            rows = spark.read.format("text").option("wholetext", "true").load(paths).withColumn("path", F.col("_metadata.file_path"))
            numbers = [int(p.rsplit("=", 1)[1]) for p in _parts(spark, f"{home}/ledger")]
            batch(rows, max(numbers, default=0) // 2 * 2 + 1)

    again()
    # Folders of devices: a stream of files needs a pattern, which also finds deeper levels by recursion.
    source = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(inbox)
    stream = source.withColumn("path", F.col("_metadata.file_path"))
    query = stream.writeStream.foreachBatch(lambda files, n: batch(files, 2 * n)).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type of a stream (or table) of events, with a watermark for late ones. An extension: the archive itself is keyed by content, not by time."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
