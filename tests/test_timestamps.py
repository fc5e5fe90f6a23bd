import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkmill.operators.timestamps import ZoneTables, normalise, to_utc_ms, unreadable, zone_table, zone_tables, zone_version


def one(text, zone=None):
    return to_utc_ms([text], [zone], zone_tables())[0]


def ms(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("text, zone, want", [
    ("2024-01-01T03:19:36.511Z", None, ms(2024, 1, 1, 3, 19, 36) + 511),
    ("2024-01-30t22:17:02.552z", None, ms(2024, 1, 30, 22, 17, 2) + 552),
    ("1704079542067842", None, 1704079542067), ("1704079542", None, 1704079542000), ("1704079542.9999", None, 1704079542999), ("1704079542067", None, 1704079542067), ("-5", None, -5000),
    ("8 Feb 2024 01:02:47 AM", "Asia/Kolkata", ms(2024, 2, 7, 19, 32, 47)), ("8 Feb 2024 12:02:47 AM", None, ms(2024, 2, 8, 0, 2, 47)), ("8 Feb 2024 12:02:47 PM", None, ms(2024, 2, 8, 12, 2, 47)),
    ("Sun, 31 Dec 2023 20:28:20 -0700", "Asia/Tokyo", ms(2024, 1, 1, 3, 28, 20)), ("20240101T032841Z", None, ms(2024, 1, 1, 3, 28, 41)), ("2024-01-01T03:27Z", None, ms(2024, 1, 1, 3, 27)),
    ("03.01.2024 16:18:03", "America/Denver", ms(2024, 1, 3, 23, 18, 3)), ("2024/01/03 19:24", "Asia/Kathmandu", ms(2024, 1, 3, 13, 39)), ("2024-01-10 19:09:16,277 +03:00", None, ms(2024, 1, 10, 16, 9, 16) + 277),
    ("2024-01-05T23:36:34.285639948Z", None, ms(2024, 1, 5, 23, 36, 34) + 285), ("2024-07-04 10:00:00 EST", None, ms(2024, 7, 4, 15)), ("2024-01-04 12:00:00 CEST", None, ms(2024, 1, 4, 10)),
    ("2024-03-10T02:30:00[America/Denver]", None, ms(2024, 3, 10, 9, 30)), ("2024-11-03T01:30:00[America/Denver]", None, ms(2024, 11, 3, 7, 30)), ("2024-10-27 02:30:00", "Europe/Berlin", ms(2024, 10, 27, 0, 30)),
    ("2024-04-07 02:30:00 Australia/Sydney", None, ms(2024, 4, 6, 15, 30)), ("2024-01-31 13:40:39", None, ms(2024, 1, 31, 13, 40, 39)), (" 2024-02-29T00:00:00Z\n", None, ms(2024, 2, 29)),
])
def test_readable(text, zone, want):
    assert one(text, zone) == want


@pytest.mark.parametrize("text", [None, "", "  ", "n/a", "NaN", "unknown", "Invalid Date", "0000-00-00T00:00:00Z", "2025-13-45T99:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:60:00Z", "32 Jan 2024 01:00:00 AM", "13 Jan 2024 13:00:00 AM",
                                  "2024-01-01 00:00:00 PST", "2024-01-01T00:00:00[No/Where]", "2024-01-01T00:00:00+25:00", "x" * 100_000, "2024-01-01X00:00:00Z", "٢٠٢٤-01-01T00:00:00Z"])
def test_unreadable(text):
    assert one(text) is None


def test_unknown_device_zone_is_unreadable():
    assert one("2024-01-01 00:00:00", "Mars/Base") is None


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "Europe/Lisbon", "UTC"]))
def test_against_zoneinfo(wall, zone):
    wall = wall.replace(microsecond=0)
    utc = wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    assert one(wall.strftime("%Y-%m-%d %H:%M:%S"), zone) == (utc - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def test_tables_have_a_version():
    assert zone_version() and zone_table("Europe/Berlin") is not None and zone_table("nope") is None


def test_frame_keeps_rows_and_clashing_columns(spark, rows):
    df = rows([(1, "1704079542", None, "x"), (1, "1704079542", None, "x"), (2, None, "UTC", None)], "id int, ts string, zone string, utc_ms string")
    got = normalise(df, "ts", "zone")
    assert sorted(got.columns) == ["id", "ts", "utc_ms", "zone"] and sorted(map(str, (r["utc_ms"] for r in got.collect()))) == ["1704079542000", "1704079542000", "None"]
    assert normalise(df.limit(0), "ts", "zone").count() == 0


def test_whole_tables_against_a_plain_parser(spark):
    """Every turn of the small tables against strptime and zoneinfo."""
    from conftest import SMALL

    from talkmill.queries.problems import instants

    zones = dict(map(tuple, spark.read.parquet(f"{SMALL}/devices.parquet").collect()))
    abbreviations = {"CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "GMT": 0, "UTC": 0, "Z": 0}
    formats = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M", "%d.%m.%Y %H:%M:%S", "%Y%m%dT%H%M%S", "%d %b %Y %I:%M:%S %p", "%a, %d %b %Y %H:%M:%S"]

    def plainly(text, device):
        if text is None:
            return None
        text = text.strip()
        if re.fullmatch(r"\d+(\.\d+)?", text):
            whole, _, part = text.partition(".")
            n = int(whole)
            return n * 1000 + int((part + "000")[:3]) if n < 1e11 else n if n < 1e14 else n // 1000
        m = re.fullmatch(r"(.*?)(?:[.,](\d+))?\s?(Z|z|[+-]\d\d:?\d\d|\[.*\]|[A-Z]{3,4}|[A-Z][a-z]+/\w+)?", text)
        for body, frac, tail in [(text, None, None), m.groups()]:
            for f in formats:
                try:
                    wall = datetime.strptime(body, f)
                except ValueError:
                    continue
                extra = int(((frac or "") + "000")[:3])
                if tail and re.match(r"[+-]", tail):
                    sign, digits = (1 if tail[0] == "+" else -1), tail[1:].replace(":", "")
                    utc = wall - sign * timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
                elif tail and tail.upper() in abbreviations:
                    utc = wall - timedelta(hours=abbreviations[tail.upper()])
                else:
                    zone = tail.strip("[]") if tail else zones.get(device) or "UTC"
                    utc = wall.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).replace(tzinfo=None)
                return (utc - datetime(1970, 1, 1)) // timedelta(milliseconds=1) + extra
        return None

    want = {("turns", r["turn_id"], t) for r in spark.read.parquet(f"{SMALL}/turns.parquet").collect() if (t := plainly(r["ts"], r["device"])) is not None}
    assert {tuple(r) for r in instants(spark, SMALL).where("src = 'turns'").collect()} == want


def test_no_length_is_too_long(spark, rows):
    zoned = "2024-03-01 10:00:00" + " " * 500 + "Europe/Berlin"
    assert one(zoned) == one("2024-03-01 09:00:00Z") and one(" " * 300 + "1709287200" + "\t" * 300) == 1_709_287_200_000
    assert one("1709287200." + "1" * 500) == 1_709_287_200_111 and one("x" * 100_000) is None and one("9" * 100_000) is None and one("2024-03-01 10:00:00 " + "Z" * 200) is None
    df = rows([("a", zoned, None), ("a", "2024-06-30 23:59:60", None), ("a", "٢٠٢٤-01-01", None), ("b", " ", None), ("b", None, None)], "src string, ts string, zone string")
    assert {tuple(r) for r in unreadable(normalise(df, "ts", "zone"), "src", "ts").collect()} == {("a", 3, 2), ("b", 0, 0)}


def test_stored_tables_give_the_same(spark, rows):
    tables = zone_tables()
    again = ZoneTables.read(tables.rows(spark), tables.version)
    assert again.version == zone_version() and set(again.of) == set(tables.of)
    df = rows([("2024-10-27 02:30:00", "Europe/Berlin"), ("1950-07-01 12:00", "America/New_York"), ("2095-07-01 12:00", "America/New_York")], "ts string, zone string")
    assert normalise(df, "ts", "zone").collect() == normalise(df, "ts", "zone", tables=again).collect()
    odd = ZoneTables("odd", {"X/Y": again.of["UTC"]})
    assert to_utc_ms(["2024-01-01 00:00:00"] * 2, ["X/Y", "UTC"], odd) == [1_704_067_200_000, None]
