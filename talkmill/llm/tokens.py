"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files and the vocabulary to count with.
TOKENIZER_DIR = os.environ.get("TALKMILL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how this public family of byte-level vocabularies splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoder(folder: str, name: str):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with ``out``: tokens of the whole text. Null counts as no tokens, as an empty text does."""
    keep = [c for c in df.columns if c not in (text, out)]
    names = [f"__c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*names, "__tokens"])

    plain = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    sized = plain.mapInArrow(run, f"{fields}__tokens bigint")
    return sized.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("__tokens").alias(out))
