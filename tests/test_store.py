from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talkmill.operators import services, store
from talkmill.schemas import LEDGER, LEDGER_SESSIONS

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2025-01-01").cast("timestamp")


def test_commits_are_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read("facts").count() == 0 and s.migrate() == s.migrate() == store.SCHEMA_VERSION
    facts = store.with_fact_defaults(spark.createDataFrame([("uses port 5", ["x"]), ("old", ["x"])], "statement string, entities array<string>"), now())
    s.commit({"facts": facts})

    def boom(x):
        raise RuntimeError("lost")
        yield x

    with pytest.raises(Exception, match="lost"):
        s.commit({"facts": facts.limit(1), "ledger_sessions": spark.createDataFrame([("a", "b")], LEDGER_SESSIONS).mapInArrow(boom, LEDGER_SESSIONS)})
    assert s.read("facts").count() == 2 and s.health(3)["rows"]["ledger_sessions"] == 0 and s.health(3)["dims_match"]
    with pytest.raises(ValueError):
        s.reset("facts")
    s.reset("facts", confirm=True)
    assert s.read("facts").count() == 0


def test_remember_and_forget(spark):
    base = store.with_fact_defaults(spark.createDataFrame([("a", "the port is 5", ["x"]), ("b", "nothing here", ["y"])], "id string, statement string, entities array<string>"), F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("n", "the port is 6", ["x"])], "id string, statement string, entities array<string>")
    verdicts = spark.createDataFrame([("n", "a"), ("n", "b"), ("n", "zz"), ("n", None)], "new_id string, id string")
    after = store.remember(base, new, verdicts, now())
    assert {r["id"]: (r["status"], r["superseded_by"]) for r in after.collect()} == {"a": ("superseded", "n"), "b": ("active", None), "n": ("active", None)}
    chunks = spark.createDataFrame([(i, "port words" if i < 25 else "other") for i in range(30)], "chunk_id int, text string")
    kept, left, rounds = store.forget(after, chunks, "port", confirm=True)
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b"] and left.count() == 5 and rounds == 3
    assert store.forget(after, chunks, "port")[1].count() == 30


def test_ledger(spark):
    row = ("1", "/p", "claude", "h1", 1, 1, 0, "ingested", None, T0)
    ledger, bridge = spark.createDataFrame([row], LEDGER), spark.createDataFrame([], LEDGER_SESSIONS)
    entries = spark.createDataFrame([("2", "/q", *row[2:]), ("3", "/r", "claude", "h2", *row[4:])], LEDGER)
    after, links = store.record_ingest(ledger, bridge, entries, spark.createDataFrame([("3", "s"), ("3", "s")], LEDGER_SESSIONS))
    assert sorted(r["id"] for r in after.collect()) == ["1", "3"] and links.count() == 1
    done = store.mark_distilled(after, spark.createDataFrame([("3",)], "id string"), now())
    assert {r["id"]: r["distilled_at"] is not None for r in done.collect()} == {"1": False, "3": True}


def test_services(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    got = {r["id"]: list(r["dense"]) for r in services.embed(df, "id", "text", lambda texts: [[float(len(t)), 0.0] for t in texts], 2).collect()}
    assert got == {1: [3.0, 0.0], 2: [0.0, 0.0]}
    with pytest.raises(Exception, match="vectors of 3"):
        services.embed(df, "id", "text", lambda texts: [[0.0]] * len(texts), 3).collect()
    with pytest.raises(Exception, match="expected"):
        store.check_dims(spark.createDataFrame([([1.0],)], "v array<float>"), "v", 2).collect()

    def picky(text):
        if len(text) > 20_000:
            raise OverflowError("long")
        if not text:
            raise ValueError("empty")
        return str(len(text))

    long = spark.createDataFrame([(1, "x" * 60_000), (2, "")], "id int, text string")
    assert {r["id"]: (r["answer"], r["error"]) for r in services.extract(long, "id", "text", picky).collect()} == {1: ("12000", None), 2: (None, "empty")}
    clean = services.redact_detected(df, "text", lambda t: ["ab", "abc", "abcd"])
    assert clean.where("id = 1").first()["text"] == "abc"
    assert services.redact_detected(spark.createDataFrame([("say hunter2!",)], "text string"), "text", lambda t: ["hunter2"]).first()[0] == "say [REDACTED:detected]!"
    with pytest.raises(ValueError):
        services.redact_detected(df, "text", None)
