"""Processing only new or changed records, exactly once across failures.

The state of a consumer is its *manifest*: the inputs (path, size, checksum) of
every batch that was committed, in order. A run lists its inputs, anti-joins the
listing with the last committed version of each, writes the result of the
remainder under its batch id (overwriting what an earlier, failed attempt left
there) and only then commits the batch's part of the manifest. A crash before the
commit repeats the batch into the same place; a crash after it repeats nothing.
One batch runs at a time: it holds the consumer's lock from its listing to its
commit, and a batch that died is repeated or released before another begins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIGITS = 64
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("number", T.LongType()),
])


def clean_hash(text: Column) -> Column:
    """The 64 hex digits of a content hash in lower case; null if it doesn't hold exactly that.

    Blanks around it, upper case and an algorithm prefix (``sha256:``) don't matter.
    """
    digits = F.regexp_extract(F.lower(text), r"^(?U:\s)*(?:[a-z0-9_-]+:)?(?U:\s)*([0-9a-f]{64})(?U:\s)*$", 1)
    return F.when(F.length(digits) == HASH_DIGITS, digits)


def pending(listing: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``listing`` whose keys the manifest doesn't have, one per key.

    Nulls: a row with a null key is never pending, for it can't be recognised
    when it comes again. Repeated rows count once.
    """
    usable = listing.dropna(subset=list(keys))
    return usable.dropDuplicates(list(keys)).join(manifest.select(*keys).dropna().distinct(), list(keys), "left_anti")


def within_runs(marks: DataFrame, at: str, runs: DataFrame, outcome: str = "ok") -> DataFrame:
    """Rows of ``marks`` whose time lies within a run of the given outcome, ends included.

    The interval join is an equi-join on the day: each run is spread over its
    days, so neither side is broadcast and no pair of far apart times is formed.
    Runs without an end or with the end before the start hold nothing.
    """
    good = runs.where((F.col("outcome") == outcome) & (F.col("started_at") <= F.col("ended_at")))
    days = good.select(
        F.col("started_at").alias("__from"), F.col("ended_at").alias("__to"),
        F.explode(F.sequence(F.to_date("started_at"), F.to_date("ended_at"))).alias("__day"),
    )
    timed = marks.where(F.col(at).isNotNull()).withColumn("__day", F.to_date(at))
    meets = F.col(at).between(F.col("__from"), F.col("__to"))
    return timed.join(days, "__day").where(meets).drop("__day", "__from", "__to")


def undistilled_contents(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """``content_hash`` of every ingested content that no successful run has distilled, each once.

    A run is a batch of the consumer and its outcome ``ok`` the commit: the marks
    within it are its part of the manifest, and the ledger is the listing.

    A mark left by a run that failed or was aborted doesn't count, nor does one
    outside every run; a mark on any row of a content, under any path and
    spelling of the hash, settles the content. Hashes that aren't 64 hex digits
    name no content. Empty tables: an empty ledger gives no row, empty runs
    leave everything pending. Extra columns are ignored.
    """
    rows = ledger.select(clean_hash(F.col("content_hash")).alias("content_hash"), "status", "distilled_at")
    rows = rows.where(F.col("content_hash").isNotNull())
    manifest = within_runs(rows, "distilled_at", runs.select("started_at", "ended_at", "outcome")).select("content_hash")
    return pending(rows.where(F.col("status") == "ingested").select("content_hash"), manifest, ["content_hash"])


def list_files(spark: SparkSession, folder: str, pattern: str = "*", known: DataFrame | None = None) -> DataFrame:
    """``path, size, checksum, modified`` of the files below ``folder``; the checksum is of the whole content, read on the executors.

    Files that ``known``, a manifest, has with the same path, size and time keep
    its checksum and aren't read. A file is hashed whole in one task; the paths
    to read are handed to the reader, whose driver lists every path in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    hashed = lambda df: df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), F.col("modificationTime").alias("modified"))
    if known is None:
        return hashed(files)
    same = ["path", "size", "modified"]
    old = listed.join(last_versions(known), same).select("path", "size", "checksum", "modified")
    paths = [r["path"] for r in listed.join(last_versions(known), same, "left_anti").select("path").toLocalIterator()]
    if not paths:
        return old
    return old.unionByName(hashed(spark.read.format("binaryFile").load([p.replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for p in paths])))


def last_versions(manifest: DataFrame) -> DataFrame:
    """The manifest's last committed row of each path."""
    last = manifest.groupBy("path").agg(F.max_by(F.struct("size", "checksum", "modified"), "number").alias("x"))
    return last.select("path", "x.*")


class IncrementalJob:
    """A consumer with a manifest: ``run`` processes what is new or changed since the last commit."""

    def __init__(self, spark: SparkSession, home: str, process: Callable[[DataFrame], DataFrame]):
        self.spark, self.home, self.process = spark, home.rstrip("/"), process
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[str]:
        at = self._fs_path(f"{self.home}/manifest")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> DataFrame:
        """Inputs of all committed batches with the number of their commit. Staged, uncommitted parts aren't visible."""
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*[f"{self.home}/manifest/{x}" for x in done])

    def results(self) -> DataFrame | None:
        """Results of committed batches only; None before the first commit."""
        done = self._committed()
        return self.spark.read.option("basePath", f"{self.home}/out").parquet(*[f"{self.home}/out/{x}" for x in done]) if done else None

    def _lock(self, batch_id: str) -> None:
        """Take the lock, or find it held by an earlier attempt of the same batch."""
        at = self._fs_path(f"{self.home}/running")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            if not self._fs.exists(at):
                raise
            holder = self.spark.read.format("text").option("wholetext", "true").load(f"{self.home}/running").first()
            if holder is None or holder[0] != batch_id:
                raise RuntimeError(f"batch {holder and holder[0]} is running or has failed; repeat or release it first") from e
            return
        out.write(bytearray(batch_id, "utf-8"))
        out.close()

    def release(self) -> None:
        """Give up a batch that failed and won't be repeated; what it staged stays invisible."""
        self._fs.delete(self._fs_path(f"{self.home}/running"), False)

    def run(self, listing: DataFrame, batch_id: str) -> bool:
        """Process what of ``listing`` (path, size, checksum, ...) is pending; False if nothing was or the batch is committed.

        Repeating a batch id that failed overwrites its partial output. A file
        that returns to an earlier content is a change like any other.
        """
        name = f"batch_id={batch_id}"
        if self._fs.exists(self._fs_path(f"{self.home}/manifest/{name}")):
            return False
        self._fs.mkdirs(self._fs_path(f"{self.home}/manifest"))
        self._lock(batch_id)
        staged, number = f"{self.home}/staging/{name}", len(self._committed()) + 1
        todo = pending(listing, last_versions(self.manifest()), ["path", "size", "checksum"])
        todo.write.mode("overwrite").parquet(staged)  # fixes the batch before it is processed
        batch = self.spark.read.parquet(staged)
        done = not batch.isEmpty()
        if done:
            self.process(batch).write.mode("overwrite").parquet(f"{self.home}/out/{name}")
            modified = F.col("modified") if "modified" in batch.columns else F.lit(None)
            part = batch.select("path", "size", "checksum", modified.cast("timestamp").alias("modified"), F.lit(number).cast("bigint").alias("number"))
            part.write.mode("overwrite").parquet(f"{staged}.manifest")
            if not self._fs.rename(self._fs_path(f"{staged}.manifest"), self._fs_path(f"{self.home}/manifest/{name}")):
                raise RuntimeError(f"batch {batch_id} could not be committed")
        self._fs.delete(self._fs_path(staged), True)
        self.release()
        return done
