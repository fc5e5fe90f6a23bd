"""Deeply nested JSON records into flat tables that keep parent-child links.

Every record is read as a stream of tokens into (path, ordinals, value) triples;
its tree is never built, so records may be nested as deeply as they like. A path
is written with ``[]`` for any array element and ``.*`` for any entry of an object
that serves as a map; the ordinals are the array positions and map keys met on
the way, so they identify a row and, cut shorter, each of its ancestors. Paths are
grouped by the repeated ancestor they hang from, and each group is pivoted into
one table. All triples of a record come from one row, so grouping and pivot
happen where the record is read and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.jsonstream import Found, plan_of, read_records

_REPEATED = re.compile(r"\[\]|\.\*")


@dataclass(frozen=True)
class FlatTable:
    """A table to make: one row per occurrence of ``path``.

    ``columns`` maps a column to a path: below the row (``type``; ``""`` is the
    row's own value) or, starting with ``$``, of an ancestor (``$.mapping.*.parent``).
    ``#type`` after a path gives the kind of value instead of the value.
    """

    name: str
    path: str
    columns: Mapping[str, str] = field(default_factory=dict)

    def absolute(self, column: str) -> str:
        path = self.columns[column].removesuffix("#type")
        if path.startswith("$"):
            return path
        return f"{self.path}{'' if not path or path.startswith('[') else '.'}{path}"


def pivot(found: Found, tables: Sequence[FlatTable]) -> Iterator[tuple[str, list[str], list[str | None]]]:
    """(table, ordinals, values in the order of the table's columns) of the wanted values of one record."""
    for table in tables:
        columns = [
            (found.get(path := table.absolute(c), {}), len(_REPEATED.findall(path)), spec.endswith("#type"))
            for c, spec in table.columns.items()
        ]
        for ordinals in found.get(table.path, {}):
            values = []
            for given, depth, kind in columns:
                value = given.get(ordinals[:depth])
                values.append(None if value is None else value.kind if kind else None if value.kind == "null" else str(value))
            yield table.name, [str(x) for x in ordinals], values


def flatten(df: DataFrame, payload: str, keep: Sequence[str], tables: Sequence[FlatTable]) -> DataFrame:
    """Rows ``keep..., flat_table, record_no, ordinals, flat_values`` for each table; see :func:`table_of`.

    ``record_no`` is the position in a top-level array, 0 for a single record.
    A payload that is null, empty or not valid JSON gives no rows. Missing and
    null fields both come out null (``#type`` tells them apart); objects, arrays
    and numbers come out as they are written. Repeated rows of ``df`` give repeated rows. Kept columns are carried as they are.
    """
    tables, names = list(tables), [f"__k{i}" for i in range(len(keep))]
    wanted = frozenset(p for t in tables for p in (t.path, *map(t.absolute, t.columns)))
    source = df.select(F.col(payload).alias("__payload"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    schema = f"{kept}{', ' if kept else ''}flat_table string, record_no bigint, ordinals array<string>, flat_values array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of(wanted)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                index, name, number, ordinals, values = [], [], [], [], []
                for i, text in enumerate(part.column(0).to_pylist()):
                    for n, found in read_records(text, plan):
                        for t, o, v in pivot(found, tables):
                            index.append(i), name.append(t), number.append(n), ordinals.append(o), values.append(v)
                take = pa.array(index, pa.int64())
                columns = [part.column(1 + i).take(take) for i in range(len(names))]
                columns += [
                    pa.array(name, pa.string()), pa.array(number, pa.int64()),
                    pa.array(ordinals, pa.list_(pa.string())), pa.array(values, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "flat_table", "record_no", "ordinals", "flat_values"])

    flat = source.mapInArrow(run, schema)
    return flat.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "flat_table", "record_no", "ordinals", "flat_values")


def columns_of(table: FlatTable) -> dict[str, Column]:
    """The columns of a table in rows of :func:`flatten`; meaningful where ``flat_table`` is its name."""
    return {c: F.get("flat_values", F.lit(i)) for i, c in enumerate(table.columns)}


def table_of(flat: DataFrame, table: FlatTable, keep: Sequence[str]) -> DataFrame:
    """One table of :func:`flatten`: kept columns, ``row_key``, ``parent_key`` (of the nearest repeated ancestor, null at the top), its columns.

    Keys are the JSON text of [record_no, ordinals...], so no key can be mistaken for another.
    """
    steps = F.concat(F.array(F.col("record_no").cast("string")), F.col("ordinals"))
    above = F.slice(steps, 1, F.size(steps) - 1)
    return flat.where(F.col("flat_table") == table.name).select(
        *keep, "ordinals",
        F.to_json(steps).alias("row_key"),
        F.when(F.size(steps) > 1, F.to_json(above)).alias("parent_key"),
        *[value.alias(c) for c, value in columns_of(table).items()],
    )
