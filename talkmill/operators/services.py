"""Calls to outside services as injected functions: embedding, extraction, detection.

The functions are the caller's and run on the executors in batches; a task that
is repeated calls them again, so they have to be idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators.chunking import batch_numbers

# The longest transcript handed to an extractor, how often it is halved, the shortest secret replaced.
TRANSCRIPT, HALVINGS, SHORTEST = 48_000, 2, 4


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], dims: int, keep_errors: bool = False) -> DataFrame:
    """``key, dense``: a vector per text from an embedder of batches bounded in number and characters. A wrong number or length of vectors is an error.

    With ``keep_errors`` an error stays with the texts of its batch (``key, dense, error``) instead of failing the job.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            groups: dict[int, list[str]] = {}
            for text_, number in zip(texts, batch_numbers(map(len, texts))):
                groups.setdefault(number, []).append(text_)
            vectors, errors = [], []
            for group in groups.values():
                try:
                    found = embedder(group)
                    if len(found) != len(group) or any(len(v) != dims for v in found):
                        raise ValueError(f"the embedder must give {len(group)} vectors of {dims}")
                    vectors.extend(found)
                    errors.extend([None] * len(group))
                except Exception as e:
                    if not keep_errors:
                        raise
                    vectors.extend([None] * len(group))
                    errors.extend([str(e) or type(e).__name__] * len(group))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["k", "dense", "error"])

    done = df.select(F.col(key), F.col(text)).mapInArrow(run, f"k {kind}, dense array<float>, error string").withColumnRenamed("k", key)
    return done if keep_errors else done.drop("error")


def extract(df: DataFrame, key: str, text: str, extractor: Callable[[str], str]) -> DataFrame:
    """``key, answer, error`` of an extractor over transcripts; one that is too much for it (OverflowError) is tried again by halves. A failure stays with its row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for whole in batch.column(1).to_pylist():
                answer = error = None
                for times in range(HALVINGS + 1):
                    try:
                        answer, error = extractor((whole or "")[: TRANSCRIPT >> times]), None
                        break
                    except OverflowError as e:
                        error = str(e)
                    except Exception as e:
                        error = str(e)
                        break
                answers.append(answer), errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["k", "answer", "error"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"k {kind}, answer string, error string").withColumnRenamed("k", key)


def redact_detected(df: DataFrame, text: str, detector: Callable[[str], list[str]] | None, mark: str = "[REDACTED:detected]") -> DataFrame:
    """``df`` with what a detector names (at least four characters) replaced in ``text``; without the configured detector it fails rather than let text through."""
    if detector is None:
        raise ValueError("a detector is configured but missing")
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for value in batch.column(at).to_pylist():
                for secret in sorted({s for s in detector(value) if len(s) >= SHORTEST}, key=len, reverse=True) if value else ():
                    value = value.replace(secret, mark)
                clean.append(value)
            columns = list(batch.columns)
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = df.toDF(*names)
    return plain.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)).toDF(*df.columns)
