from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talkmill.operators.incremental import IncrementalJob, clean_hash, list_files, pending, undistilled_contents

LEDGER = "content_hash string, status string, distilled_at timestamp, path string"
RUNS = "started_at timestamp, ended_at timestamp, outcome string, status string"


def h(c):
    return c * 64


def at(d, hour=0):
    return datetime(2024, 1, d, hour)


def test_hash_spellings(spark, rows):
    data = [(f" SHA256:{h('A')} ",), (h("a")[1:],), (h("g"),), (None,), ("",), (h("b") + "\n",), (h("c") + h("c"),)]
    got = [r[0] for r in rows(data, "x string").select(clean_hash(F.col("x"))).collect()]
    assert got == [h("a"), None, None, None, None, h("b"), None]


def test_only_marks_of_successful_runs_settle(spark, rows):
    runs = rows([(at(1), at(3), "ok", None), (at(5), at(6), "failed", None), (at(8), None, "aborted", None), (at(9), at(10), "ok", None)], RUNS)
    ledger = rows([
        (h("1"), "ingested", at(2), "a"), (h("1").upper(), "ingested", None, "b"), (h("2"), "ingested", at(5, 3), "a"), (h("3"), "ingested", None, "a"), (h("3"), "ingested", None, "a"),
        (h("4"), "quarantined", None, "a"), (h("5"), "ingested", at(9), None), (h("6"), "ingested", at(10), None), (h("7"), "ingested", at(7), None), (None, "ingested", None, None),
        (h("8"), "quarantined", at(2), None), (h("8"), "ingested", None, None), (h("9"), None, None, None),
    ], LEDGER)
    assert sorted(r[0] for r in undistilled_contents(ledger, runs).collect()) == [h("2"), h("3"), h("7")]


def test_empty_tables(spark, rows):
    none = rows([], RUNS)
    assert undistilled_contents(rows([], LEDGER), none).count() == 0
    assert undistilled_contents(rows([(h("1"), "ingested", at(2), "a")], LEDGER), none).count() == 1


def test_pending_is_per_key(spark, rows):
    listing = rows([("a", 1), ("a", 1), ("b", 2), (None, 3)], "path string, size int")
    assert sorted(r["path"] for r in pending(listing, rows([("b", 2)], "path string, size int"), ["path", "size"]).collect()) == ["a"]


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    inbox, home = tmp_path / "in", str(tmp_path / "home")
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    (inbox / "b.txt").write_text("two")
    fail = {"on": True}

    def work(batch):
        if fail["on"]:
            raise RuntimeError("lost")
        return batch.select("path")

    job = IncrementalJob(spark, home, work)
    listing = list_files(spark, str(inbox))
    with pytest.raises(RuntimeError):
        job.run(listing, "1")
    assert job.results() is None and job.manifest().count() == 0
    fail["on"] = False
    assert job.run(listing, "1") and not job.run(listing, "1") and not job.run(listing, "2")
    (inbox / "a.txt").write_text("changed")
    (inbox / "c.txt").write_text("three")
    assert job.run(list_files(spark, str(inbox)), "3")
    assert sorted(r["path"][-5:] for r in job.results().collect()) == ["a.txt", "a.txt", "b.txt", "c.txt"]
    assert job.manifest().count() == 4


def test_a_file_that_returns_to_an_earlier_content_is_processed(spark, tmp_path):
    inbox, home = tmp_path / "in", str(tmp_path / "home")
    inbox.mkdir()
    job, ran = IncrementalJob(spark, home, lambda batch: batch.select("path", "checksum")), []
    for i, text in enumerate(["A", "B", "A", "A"]):
        (inbox / "a.txt").write_text(text)
        ran.append(job.run(list_files(spark, str(inbox)), str(i)))
    assert ran == [True, True, True, False] and job.results().count() == 3


def test_two_runs_at_once(spark, tmp_path):
    inbox, home = tmp_path / "in", str(tmp_path / "home")
    inbox.mkdir()
    (inbox / "a.txt").write_text("A")
    listing, refused = list_files(spark, str(inbox)), []

    def work(batch):
        with pytest.raises(RuntimeError, match="batch 1 is running"):
            IncrementalJob(spark, home, lambda b: b.select("path")).run(listing, "2")
        refused.append(1)
        return batch.select("path")

    assert IncrementalJob(spark, home, work).run(listing, "1") and refused
    assert not IncrementalJob(spark, home, work).run(listing, "2")


def test_a_dead_batch_is_repeated_or_released(spark, tmp_path):
    inbox, home = tmp_path / "in", str(tmp_path / "home")
    inbox.mkdir()
    (inbox / "a.txt").write_text("A")
    listing = list_files(spark, str(inbox))
    dead, job = IncrementalJob(spark, home, lambda batch: 1 / 0), IncrementalJob(spark, home, lambda batch: batch.select("path"))
    with pytest.raises(ZeroDivisionError):
        dead.run(listing, "1")
    with pytest.raises(RuntimeError):
        job.run(listing, "2")
    job.release()
    assert job.run(listing, "2") and job.results().count() == 1


def test_known_files_are_not_read_again(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a [1].txt").write_text("A")
    (inbox / "b.txt").write_text("B")
    first = {r["path"][-5:]: r for r in list_files(spark, str(inbox)).collect()}
    known = list_files(spark, str(inbox)).selectExpr("path", "size", "concat('kept ', checksum) AS checksum", "modified", "1L AS number")
    known = spark.createDataFrame(known.collect(), known.schema)
    (inbox / "b.txt").write_text("BB")
    again = {r["path"][-5:]: r for r in list_files(spark, str(inbox), known=known).collect()}
    assert again["].txt"]["checksum"] == "kept " + first["].txt"]["checksum"] and len(again) == 2
    assert again["b.txt"]["size"] == 2 and not again["b.txt"]["checksum"].startswith("kept")
