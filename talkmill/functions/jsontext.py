"""JSON inside free text, as language models answer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.jsonstream import compact

_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_SIGN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|"', re.S)
_CONTROL = re.compile(r"[\x00-\x1f]")


def extract_json(text: str | None) -> str | None:
    """The first JSON array or object of a text as compact JSON; None if there is none or it doesn't end.

    A fenced block is preferred to the whole text. Raw control characters within strings are escaped first.
    """
    if not text:
        return None
    fenced = _FENCED.search(text)
    body = fenced[1] if fenced else text
    begin = re.search(r"[\[{]", body)
    if not begin:
        return None
    opens, closes = body[begin.start()], {"[": "]", "{": "}"}[body[begin.start()]]
    depth = 0
    for sign in _SIGN.finditer(body, begin.start()):
        depth += (sign[0] == opens) - (sign[0] == closes)
        if depth == 0:
            found = body[begin.start() : sign.end()]
            escaped = _SIGN.sub(lambda m: _CONTROL.sub(lambda c: f"\\u{ord(c[0]):04x}", m[0]) if m[0][0] == '"' else m[0], found)
            return compact(escaped)
    return None


def with_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, json`` of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(extract_json, batch.column(1).to_pylist()), pa.string())], names=["k", "json"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"k {kind}, json string").withColumnRenamed("k", key)
