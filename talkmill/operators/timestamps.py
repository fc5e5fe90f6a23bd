"""Timestamps in many spellings and zones to one UTC instant in milliseconds.

A value is reduced to its shape mask (digits to ``9``, letters to ``a``). Each
distinct mask is mapped to a parser (the slices of its fields) once and the
parser is kept; all values of a batch with that mask are then cut and computed
together with NumPy. Wall times go through per-zone tables of transitions. The
driver makes them once, from one version of the time zone database, and sends
them along (``ZoneTables``, about 3 MB whatever the data), so no executor's own
database can matter; a set of tables can be stored and used again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Abbreviations and their offsets in hours, month names.
ABBREVIATIONS = {"CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "GMT": 0, "UTC": 0, "Z": 0}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLASS = bytes(57 if 48 <= c <= 57 else 97 if chr(c).isalpha() and c < 128 else c if c < 128 else 63 for c in range(256))
_TIME = r"(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?"
_REST = r"(?P<rest>.*)"
_SHAPES = [
    re.compile(rf"(?P<Y>9999)(?P<q>[-/.])(?P<M>99)(?P=q)(?P<D>99)(?:(?P<t>a)| ){_TIME}{_REST}"),
    re.compile(r"(?P<Y>9999)(?P<q>[-/.])(?P<M>99)(?P=q)(?P<D>99)"),
    re.compile(rf"(?P<D>99?)\.(?P<M>99?)\.(?P<Y>9999),? {_TIME}{_REST}"),
    re.compile(rf"(?:aaa,? )?(?P<D>99?) (?P<b>aaa)a{{0,12}} (?P<Y>9999),? {_TIME}{_REST}"),
    re.compile(rf"(?P<Y>9999)(?P<M>99)(?P<D>99)(?P<t>a)(?P<h>99)(?P<m>99)(?:(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?)?{_REST}"),
]
_NUMBER = re.compile(r"(?P<n>-)?(?P<i>9{1,17})(?:\.(?P<f>9+))?")
#: All fields of a time lie within its first characters.
_HEAD = 64
_ZONES_FROM, _ZONES_TO, _STEP = 1900, 2100, 45
_DAY_MS = 86_400_000


Table = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class ZoneTables:
    """``version`` of the database and, per zone, (wall times in ms from which the next offset holds, offsets in ms)."""

    version: str
    of: dict[str, Table]

    def rows(self, spark: SparkSession) -> DataFrame:
        """``version, zone, bounds, offsets``: the tables to store; see :meth:`read`."""
        data = [(self.version, zone, bounds.tolist(), offsets.tolist()) for zone, (bounds, offsets) in sorted(self.of.items())]
        return spark.createDataFrame(data, "version string, zone string, bounds array<bigint>, offsets array<bigint>")

    @staticmethod
    def read(rows: DataFrame, version: str) -> ZoneTables:
        """The stored tables of a version: some 600 rows."""
        of = {r["zone"]: (np.array(r["bounds"], np.int64), np.array(r["offsets"], np.int64)) for r in rows.where(F.col("version") == version).collect()}
        if not of:
            raise ValueError(f"no zone tables of version {version}")
        return ZoneTables(version, of)


def zone_version() -> str:
    """Version of the time zone database of this machine."""
    from pathlib import Path
    from zoneinfo import TZPATH

    for folder in TZPATH:
        listing = Path(folder) / "tzdata.zi"
        if listing.is_file():
            with listing.open() as lines:
                return lines.readline().split()[-1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unnamed"


def _moments(name: str, first: int, last: int) -> np.ndarray:
    """Times (s) between which a zone's offset changes at most once: the transitions its file lists, and steps of a few weeks where a rule holds instead."""
    from pathlib import Path
    from zoneinfo import TZPATH

    listed = np.zeros(0, np.int64)
    path = next((p for folder in TZPATH if (p := Path(folder) / name).is_file()), None)
    data = path.read_bytes() if path else b""
    if data[:4] == b"TZif" and data[4:5] >= b"2":
        counts = lambda at: [int.from_bytes(data[at + 20 + 4 * i : at + 24 + 4 * i], "big") for i in range(6)]
        utc, std, leap, times, kinds, chars = counts(0)
        at = 44 + times * 5 + kinds * 6 + chars + leap * 8 + std + utc
        listed = np.frombuffer(data, ">i8", counts(at)[3], at + 44).astype(np.int64)
    ruled = not path or b"," in data.rstrip(b"\n").rsplit(b"\n", 1)[-1]
    since = max(first, int(listed[-1])) if len(listed) else first
    steps = np.arange(since, last, _STEP * 86_400) if ruled else listed[:0]
    within = listed[(listed > first) & (listed < last)]
    return np.unique(np.concatenate([[first], within, within - 1, steps, [last]]))


def zone_table(name: str) -> Table | None:
    """The table of a zone; None if there is no such zone.

    The bound of each transition is its UTC time plus the larger of both
    offsets: a wall time that occurs twice then takes the earlier offset (the
    first occurrence), one that is skipped moves forward by the gap.
    """
    from zoneinfo import ZoneInfo

    try:
        zone = ZoneInfo(name)
    except Exception:  # a name can fail in many ways: unknown, a folder, odd characters
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    offset = lambda t: int((epoch + timedelta(seconds=int(t))).astimezone(zone).utcoffset().total_seconds())
    ends = [int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in (_ZONES_FROM, _ZONES_TO)]
    moments = _moments(name, *ends)
    bounds, offsets = [], [offset(moments[0])]
    for low, high in zip(moments.tolist(), moments[1:].tolist()):
        new = offset(high)
        if new == offsets[-1]:
            continue
        while high - low > 1:
            middle = (low + high) // 2
            if offset(middle) == offsets[-1]:
                low = middle
            else:
                high = middle
        bounds.append((high + max(offsets[-1], new)) * 1000)
        offsets.append(new)
    return np.array(bounds, np.int64), np.array(offsets, np.int64) * 1000


@lru_cache(maxsize=1)
def zone_tables() -> ZoneTables:
    """The tables of all zones of this machine's database."""
    from zoneinfo import available_timezones

    return ZoneTables(zone_version(), {name: table for name in sorted(available_timezones()) if (table := zone_table(name)) is not None})


@lru_cache(maxsize=65_536)
def zone_of(rest: str) -> tuple[str, object] | None:
    """What follows a time: ("fixed", ms), ("zone", name), ("half", hours to add, 0 or 12), ("none", 0); None if it can't be read. Whether there is such a zone is seen later."""
    text = rest.strip()
    if not text:
        return "none", 0
    if text.upper() in ("AM", "PM"):
        return "half", 12 * (text.upper() == "PM")
    if m := re.fullmatch(r"([+-])(\d\d)(?::?(\d\d))?", text):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return ("fixed", (1 if m[1] == "+" else -1) * minutes * 60_000) if minutes <= 18 * 60 and int(m[3] or 0) < 60 else None
    if text.upper() in ABBREVIATIONS:
        return "fixed", ABBREVIATIONS[text.upper()] * 3_600_000
    if m := re.fullmatch(r"\[([A-Za-z0-9_+/-]+)\]|([A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*)", text):
        return "zone", m[1] or m[2]
    return None


@lru_cache(maxsize=65_536)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """("date" or "number", slices of its fields) for a mask; None for a shape that is no time."""
    if m := _NUMBER.fullmatch(mask):
        return "number", {k: m.span(k) for k in m.groupdict() if m[k] is not None}
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            return "date", {k: m.span(k) for k in m.groupdict() if m[k] is not None}
    return None


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = chars[:, span[0] : span[1]].astype(np.int64) - 48
    return part @ (10 ** np.arange(part.shape[1] - 1, -1, -1, dtype=np.int64))


def _numbers(chars: np.ndarray, spans: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    whole = _digits(chars, spans["i"])
    thousandths = np.zeros(len(chars), np.int64)
    if "f" in spans:
        start, end = spans["f"][0], min(spans["f"][1], spans["f"][0] + 3)
        thousandths = _digits(chars, (start, end)) * 10 ** (3 - (end - start))
    ms = np.where(whole < 10**11, whole * 1000 + thousandths, np.where(whole < 10**14, whole, whole // 1000))
    return (-ms if "n" in spans else ms), np.ones(len(chars), bool)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of a date of the Gregorian calendar."""
    month = (y - 1970) * 12 + (m - 1)
    return month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _dates(texts: list[str], chars: np.ndarray, spans: dict[str, tuple[int, int]], zones: list[str], tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    count = len(texts)
    zero = np.zeros(count, np.int64)
    ok = np.ones(count, bool)
    get = lambda k: _digits(chars, spans[k]) if k in spans else zero
    if "t" in spans:
        ok &= np.isin(chars[:, spans["t"][0]], [ord("T"), ord("t")])
    if "b" in spans:
        names = [t[spans["b"][0] : spans["b"][1]].lower() for t in texts]
        month = np.array([MONTHS.index(n) + 1 if n in MONTHS else 0 for n in names], np.int64)
    else:
        month = get("M")
    year, day, hour, minute, second = get("Y"), get("D"), get("h"), get("m"), get("s")
    ok &= (year > 0) & (month >= 1) & (month <= 12) & (day >= 1) & (minute < 60) & (second < 60)
    month = np.where(ok, month, 1)
    year = np.where(ok, year, 1970)
    length = _days(year + month // 12, month % 12 + 1, zero + 1) - _days(year, month, zero + 1)
    ok &= day <= length
    kinds = [zone_of(t[spans["rest"][0] :]) if "rest" in spans else ("none", 0) for t in texts]
    half = np.array([k is not None and k[0] == "half" for k in kinds], bool)
    add = np.array([k[1] if k is not None and k[0] == "half" else 0 for k in kinds], np.int64)
    ok &= np.where(half, (hour >= 1) & (hour <= 12), hour < 24)
    hour = np.where(half, hour % 12 + add, hour)
    ms = zero
    if "f" in spans:
        start, end = spans["f"][0], min(spans["f"][1], spans["f"][0] + 3)
        ms = _digits(chars, (start, end)) * 10 ** (3 - (end - start))
    wall = _days(year, month, np.where(ok, day, 1)) * _DAY_MS + hour * 3_600_000 + minute * 60_000 + second * 1000 + ms
    utc = wall.copy()
    by_zone: dict[str, list[int]] = {}
    for i, kind in enumerate(kinds):
        if kind is None:
            ok[i] = False
        elif kind[0] == "fixed":
            utc[i] -= kind[1]
        else:
            by_zone.setdefault(kind[1] if kind[0] == "zone" else zones[i], []).append(i)
    for name, rows in by_zone.items():
        table = tables.of.get(name)
        if table is None:
            ok[rows] = False
        else:
            utc[rows] -= table[1][np.searchsorted(table[0], wall[rows], side="right")]
    return utc, ok


def to_utc_ms(values: list[str | None], zones: list[str | None], tables: ZoneTables) -> list[int | None]:
    """UTC milliseconds of each value, None where it is null or can't be read; ``zones`` are those of wall times (null: UTC)."""
    out: list[int | None] = [None] * len(values)
    groups: dict[bytes, list[int]] = {}
    texts = [v.strip() if v else "" for v in values]
    for i, text in enumerate(texts):
        if text:
            groups.setdefault(text.encode("latin-1", "replace").translate(_CLASS), []).append(i)
    for mask, rows in groups.items():
        shape = mask.decode("ascii")
        parser = parser_of(shape) if len(shape) <= _HEAD else parser_of.__wrapped__(shape)
        if parser is None:
            continue
        some = [texts[i] for i in rows]
        if not all(map(str.isascii, some)):
            rows = [i for i in rows if texts[i].isascii()]
            some = [texts[i] for i in rows]
            if not rows:
                continue
        chars = np.array([t[:_HEAD] for t in some], f"U{min(len(mask), _HEAD)}").view(np.uint32).reshape(len(some), -1)
        kind, spans = parser
        ms, ok = _numbers(chars, spans) if kind == "number" else _dates(some, chars, spans, [zones[i] or "UTC" for i in rows], tables)
        for i, value, good in zip(rows, ms.tolist(), ok.tolist()):
            if good:
                out[i] = value
    return out


def normalise(df: DataFrame, value: str, zone: str, out: str = "utc_ms", tables: ZoneTables | None = None) -> DataFrame:
    """Add ``out``: UTC milliseconds of the string column ``value``; further digits are cut off.

    Numbers count seconds, milliseconds or microseconds by size. A time without
    a zone is wall time of ``zone`` (null: UTC; a name the database doesn't
    know: unreadable). Null, blank and impossible values (a second 60 among them) and
    such with characters beyond ASCII give null; :func:`unreadable` counts them. Rows,
    repeated ones too, and other columns are kept; ``out`` replaces a column of
    that name. ``tables`` are those of this driver's database if none are given.
    """
    tables = tables or zone_tables()
    names = [f"__c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    v, z = names[df.columns.index(value)], names[df.columns.index(zone)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = to_utc_ms(batch.column(v).to_pylist(), batch.column(z).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.int64())], names=[*batch.schema.names, "__out"])

    dated = plain.mapInArrow(run, f"{fields}, __out bigint")
    return dated.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names) if c != out], F.col("__out").alias(out))


def unreadable(dated: DataFrame, by: str, value: str, out: str = "utc_ms") -> DataFrame:
    """``by, given, unreadable``: how many values of each group aren't blank, and how many of them could not be read."""
    given = F.coalesce(F.col(value).rlike(r"(?U)\S"), F.lit(False))
    return dated.groupBy(by).agg(F.count_if(given).alias("given"), F.count_if(given & F.col(out).isNull()).alias("unreadable"))
