"""Lexical, vector and fused search over the archive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.functions.text import any_of, fnv1a, saturated, tokenize
from talkmill.functions.vector import cosine

#: Constant of reciprocal rank fusion; the rank counts from 0.
RRF_K = 2.0
PREFETCH_FACTOR, PREFETCH_LEAST = 3, 30


def _words(archive: DataFrame, key: str, text: str) -> DataFrame:
    """``key, __row, word``: every word with the row it stands in."""
    rows = archive.select(key, tokenize(F.col(text)).alias("__words"), F.monotonically_increasing_id().alias("__row"))
    return rows.select(key, "__row", F.explode("__words").alias("word"))


def counted(archive: DataFrame, key: str, text: str, token: Column) -> DataFrame:
    """``key, token_id, n``: how often each token occurs in each row; rows delivered twice count once.

    Occurrences are counted within their row before anything moves, and what
    moves is (key, row, token, count): no text does.
    """
    words = _words(archive, key, text)
    per_row = words.groupBy(key, "__row", "word").agg(F.count("*").alias("n"))
    hashed = per_row.select(key, "__row", token.alias("token_id"), "n").groupBy(key, "__row", "token_id").agg(F.sum("n").alias("n"))
    return hashed.groupBy(key, "token_id").agg(F.max("n").alias("n"))


def postings(archive: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, token_id, n`` of all hashed tokens. Stored, it is what :func:`search_postings` reads."""
    return counted(archive, key, text, fnv1a(F.col("word")))


def sparse_vectors(archive: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, token_id, weight`` with saturated term frequencies."""
    return postings(archive, key, text).select(key, "token_id", saturated(F.col("n")).alias("weight"))


def idf(vectors: DataFrame, rows: int) -> DataFrame:
    """``token_id, df, idf`` over ``rows`` texts, including those without a token."""
    df = vectors.groupBy("token_id").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def query_vector(spark: SparkSession, query: str) -> DataFrame:
    """``token_id, q`` of a query text."""
    one = spark.createDataFrame([(0, query)], "q_id int, text string")
    return sparse_vectors(one, "q_id").select("token_id", F.col("weight").alias("q"))


def _wanted(spark: SparkSession, query: str) -> dict[int, float]:
    """Tokens of a query with their weights: one per word."""
    return {r["token_id"]: r["q"] for r in query_vector(spark, query).collect()}


def _scores(hits: DataFrame, key: str, wanted: dict[int, float], rows: int) -> DataFrame:
    df = hits.groupBy("token_id").agg(F.count("*").alias("df"))
    q = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("token_id")] if wanted else F.lit(0.0)
    weight = F.log((F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return hits.join(df, "token_id").groupBy(key).agg(F.sum(q * weight * saturated(F.col("n"))).alias("score"))


def search_postings(postings: DataFrame, key: str, query: str, rows: int) -> DataFrame:
    """``key, score`` of stored postings: q x idf x weight, summed over the tokens they share with the query; reads those tokens' postings only."""
    wanted = _wanted(postings.sparkSession, query)
    return _scores(postings.where(F.col("token_id").isin(*wanted)), key, wanted, rows)


def sparse_scores(archive: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """``key, score`` of the rows that share a token with the query, from the texts themselves.

    The texts are read once; of their words only those that hash to a token of
    the query are counted, and only these counts move.
    """
    wanted = _wanted(archive.sparkSession, query)
    terms = _words(archive, key, text).select(key, "__row", fnv1a(F.col("word")).alias("token_id")).where(F.col("token_id").isin(*wanted))
    found = terms.groupBy(key, "__row", "token_id").agg(F.count("*").alias("n")).groupBy(key, "token_id").agg(F.max("n").alias("n"))
    return _scores(found, key, wanted, archive.select(key).distinct().count())


def dense_scores(archive: DataFrame, key: str, vector: list[float], column: str = "embedding") -> DataFrame:
    """``key, score``: cosine with a query vector, which is a literal in the plan. Vectors of another length are an error of the data and score null."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return archive.select(key, cosine(F.col(column), query).alias("score"))


def top(scores: DataFrame, key: str, limit: int) -> DataFrame:
    return scores.where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(limit)


def ranked(scores: DataFrame, key: str, limit: int) -> DataFrame:
    """The best ``limit`` rows with ``rank0``. The window runs over at most ``limit`` rows."""
    return top(scores, key, limit).withColumn("rank0", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def fuse(legs: list[DataFrame], key: str, limit: int, k: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked legs: ``key, score``, best first."""
    rows = legs[0].select(key, "rank0")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select(key, "rank0"))
    fused = rows.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank0"))).alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(limit)


def prefetch(limit: int) -> int:
    return max(PREFETCH_FACTOR * limit, PREFETCH_LEAST)


def hybrid(archive: DataFrame, key: str, query: str, vector: list[float], limit: int = 5, k: float = RRF_K) -> DataFrame:
    """``key, score`` of both legs fused; a filter belongs on ``archive``, before either leg is cut."""
    width = prefetch(limit)
    dense = dense_scores(archive, key, vector).groupBy(key).agg(F.max("score").alias("score"))
    return fuse([ranked(dense, key, width), ranked(sparse_scores(archive, key, query), key, width)], key, limit, k)


def archive_filter(source_tool: str | None = None, project: str | None = None, session_id: str | None = None, after: int | None = None, before: int | None = None) -> Column:
    """Conjunction of the given conditions; blank ones don't count, and a row without ts fails any range."""
    condition = F.lit(True)
    for column, value in (("source_tool", source_tool), ("project", project), ("session_id", session_id)):
        if value and value.strip():
            condition = condition & (F.col(column) == value)
    if after is not None:
        condition = condition & (F.col("ts") >= after)
    if before is not None:
        condition = condition & (F.col("ts") <= before)
    return condition


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (wanted, words of a phrase): words are all required, ``or`` separates, ``-`` excludes, quotes make phrases."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query):
        text, wanted = (phrase, not minus) if not word else (word.lstrip("-"), not word.startswith("-"))
        if word and word.lower() == "or":
            groups.append([])
            continue
        words = re.findall(r"\w+", text.lower())
        if words:
            groups[-1].append((wanted, words))
    return [g for g in groups if g]


def matches_websearch(words: Column, query: str) -> Column:
    """Whether an array of lower-case words satisfies a query."""

    def phrase(parts: list[str]) -> Column:
        if len(parts) == 1:
            return F.array_contains(words, parts[0])
        spots = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
        return F.exists(spots, lambda i: F.slice(words, i, len(parts)) == F.array(*map(F.lit, parts)))

    options = []
    for group in parse_websearch(query):
        condition = F.lit(True)
        for wanted, parts in group:
            condition = condition & (phrase(parts) if wanted else ~phrase(parts))
        options.append(condition)
    return any_of(options) if options else F.lit(False)


def fulltext(facts: DataFrame, query: str, category: str | None = None, project: str | None = None, limit: int = 50) -> DataFrame:
    """Active facts that match a query, by the number of query words they hold, at most ``limit``; blank filters don't count."""
    words = F.split(F.lower("statement"), r"[^\p{L}\p{N}_]+")
    terms = sorted({w for g in parse_websearch(query) for wanted, ws in g if wanted for w in ws})
    rank = F.size(F.filter(words, lambda w: w.isin(*terms))) if terms else F.lit(0)
    rows = facts.where(F.col("status") == "active").where(matches_websearch(words, query))
    if category:
        rows = rows.where(F.col("category") == category)
    if project and project.strip():
        rows = rows.where(F.col("project") == project)
    return rows.withColumn("rank", rank.cast("bigint")).orderBy(F.desc("rank"), "id").limit(limit)
