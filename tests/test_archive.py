from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkmill.operators import archive as ar
from talkmill.operators import chunking, evaluation, search
from talkmill.operators.knn import knn
from talkmill.plans.prefix import running_total

CHUNKS = "chunk_id int, session_id string, source_tool string, device string, project string, ts bigint, turn_range string, text string"


def chunk(i, session, turns, ts=1, text="t", project=None):
    return (i, session, "claude", None, project, ts, turns, text)


def test_timeline_and_sessions(spark, rows):
    df = rows([chunk(i, "s", t) for i, t in enumerate(["0", "1", "2-3", "4", "10"])] + [chunk(9, "other", "0", None)], CHUNKS)
    ids = lambda d: sorted(r["chunk_id"] for r in d.collect())
    assert ids(ar.timeline(df, "s", 2, 1)) == [1, 2, 3] and ids(ar.timeline(df, "s", 0, 2)) == [0, 1, 2] and ids(ar.timeline(df, "s", 77)) == []
    assert [r["session_id"] for r in ar.recent_sessions(df).collect()] == ["s", "other"]
    assert [r["chunk_id"] for r in ar.session_scroll(df, "s").collect()] == [0, 1, 2, 3, 4]


def test_budget_upsert_delete(spark, rows):
    df = rows([(1, 5), (2, 5), (3, 1)], "id int, n int")
    assert [r["id"] for r in ar.budget_truncate(df, ["id"], "n", 10).collect()] == [1, 2]
    assert sorted(map(tuple, ar.upsert(df, rows([(2, 9), (4, 0)], "id int, n int"), "id").collect())) == [(1, 5), (2, 9), (3, 1), (4, 0)]
    assert ar.delete_where(df, rows([(1,), (1,)], "id int"), "id").count() == 2


def test_budget_cuts_a_first_block_into_it(spark, rows):
    df = rows([(i, "h" * 10, t, len(t)) for i, t in enumerate(["x" * 300, "y"])], "id int, header string, text string, n int")
    cut = lambda budget, d=df: [(r["id"], r["text"], r["n"], r["used"]) for r in ar.budget_truncate(d, ["id"], "n", budget, "text", "header").collect()]
    assert cut(200) == [(0, "x" * 180 + "\n[truncated]\n>>>", 196, 196)] and cut(90) == []
    assert cut(300) == [(0, "x" * 300, 300, 300)] and cut(200, df.where("id = 1")) == [(1, "y", 1, 1)] and cut(200, df.limit(0)) == []


def test_merge_same_role(spark, rows):
    df = rows([("s", 0, "user", "a"), ("s", 1, "user", "b"), ("s", 2, None, "c"), ("s", 3, "user", "d")], "session_id string, turn_index int, role string, text string")
    assert sorted((r["island"], r["text"]) for r in ar.merge_same_role(df).collect()) == [(1, "a\n\nb"), (2, "c"), (3, "d")]


def test_fold_merges_overlaps_and_splits():
    small = [(i, "user", "hi") for i in range(4)]
    assert [x[:2] for x in chunking.fold_session(small)] == [(0, 3)]
    large = [(i, "user", "x" * 1000) for i in range(3)]
    assert [x[:2] for x in chunking.fold_session(large)] == [(0, 1), (1, 2)]
    code = "```\n" + "\n".join("line %d" % i for i in range(250)) + "\n```"
    parts = chunking.split_oversized("intro\n\n" + code + "\n\noutro")
    assert code in parts and all(p.strip() for p in parts)
    assert list(chunking.fold_session([(0, "user", "a" * 5000), (1, "user", "b")]))[-1][:2] == (1, 1)
    assert list(chunking.batch_numbers([20_000, 5, 9000, 9000])) == [0, 1, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n`", min_size=1, max_size=3000), max_size=12))
def test_every_turn_is_covered(texts):
    chunks = list(chunking.fold_session((i, "user", t) for i, t in enumerate(texts)))
    covered = {n for first, last, _ in chunks for n in range(first, last + 1)}
    assert covered == set(range(len(texts)))


def test_chunk_frame(spark, rows):
    df = rows([("s", 1, "user", "b"), ("s", 0, None, "a"), (None, 0, "user", "x"), ("e", 0, "user", None)], "session_id string, turn_index int, role string, text string")
    assert [(r["session_id"], r["turn_range"], r["text"]) for r in chunking.chunk_sessions(df).collect()] == [("s", "0-1", ": a\n\nuser: b")]
    assert chunking.chunk_sessions(df.limit(0)).count() == 0


def test_running_total_spreads_a_hot_group(spark, rows):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["t"] for r in running_total(df, ["g"], ["id"], F.col("v"), "t").collect()}
    total, want = {}, {}
    for i in range(3000):
        g = "hot" if i % 3 else str(i)
        want[i] = total[g] = total.get(g, 0) + i % 7
    assert got == want


def test_websearch(spark, rows):
    df = rows([("1", "set the port to five", "active"), ("2", "port set", "active"), ("3", "the exporter", "active"), ("4", "set the port", "deleted")], "id string, statement string, status string").withColumn("category", F.lit("fact")).withColumn("project", F.lit(None).cast("string"))
    ids = lambda q: sorted(r["id"] for r in search.fulltext(df, q).collect())
    assert ids('"set the port"') == ["1"] and ids("port -the") == ["2"] and ids("exporter or five") == ["1", "3"] and ids("") == []


def test_fusion_and_filter(spark, rows):
    legs = [rows([("a", 0), ("b", 1)], "k string, rank0 int"), rows([("b", 0)], "k string, rank0 int")]
    assert [r["k"] for r in search.fuse(legs, "k", 5).collect()] == ["b", "a"]
    df = rows([chunk(1, "s", "0", 5, project="p"), chunk(2, "s", "1", None, project="p")], CHUNKS)
    assert [r["chunk_id"] for r in df.where(search.archive_filter(project="p", after=5)).collect()] == [1]


def test_knn_and_quality(spark, rows):
    df = rows([(i, [1.0, float(i)]) for i in range(6)] + [(9, None)], "id bigint, v array<float>")
    got = knn(df, df.where("id in (0, 9)").withColumnRenamed("id", "qid"), "id", "v", 2, block=1).orderBy("rank0").collect()
    assert [(r["qid"], r["id"]) for r in got] == [(0, 1), (0, 2)]
    results = rows([(1, "a", 0), (1, "b", 1), (2, "x", 4)], "qid int, session_id string, rank0 int")
    golden = rows([(1, ["b"]), (2, ["x", "y"]), (3, ["q"])], "qid int, expected array<string>")
    assert [round(x, 4) for x in evaluation.recall_mrr(results, golden).first()] == [3, 0.6667, round((0.5 + 0.2) / 3, 4)]
    assert evaluation.nearest_rank(spark.range(20).toDF("v"), "v").first()["value"] == 19
