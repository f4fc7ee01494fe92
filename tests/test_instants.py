from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from millrace.operators import instants, zones

SOURCES = [("berlin", "Europe/Berlin", "DMY"), ("york", "America/New_York", "MDY"), ("plain", None, "YMD"), (None, "Asia/Tokyo", "DMY")]


def utc(*a: int) -> int:
    return int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


CASES = [
    ("berlin", "2025-07-01T10:00:00", "ok", utc(2025, 7, 1, 8)),
    ("berlin", "7. Juni 2025, 23:48 Uhr", "ok", utc(2025, 6, 7, 21, 48)),
    ("berlin", "30.03.2025 02:30:00", "skipped", None),
    ("berlin", "26.10.2025 02:30:00", "ambiguous", None),
    ("berlin", "26.10.2025 03:00:00", "ok", utc(2025, 10, 26, 2)),
    ("berlin", "26.10.2025 02:30:00 CEST", "ok", utc(2025, 10, 26, 0, 30)),
    ("york", "11/2/2025 1:30 AM", "ambiguous", None),
    ("york", "11/02/2025 01:30 AM EST", "ok", utc(2025, 11, 2, 6, 30)),
    ("york", "3/9/2025 2:30 am", "skipped", None),
    ("york", "8/3/25 12:05 AM", "ok", utc(2025, 8, 3, 4, 5)),
    ("york", "13/3/2025 10:15 pm", "unreadable", None),
    ("york", "8/3/2025 13:15 pm", "unreadable", None),
    ("york", "2025-04-13 19:17:16 America/Phoenix", "ok", utc(2025, 4, 14, 2, 17, 16)),
    ("york", "2025-04-13 19:17:16 Mars/Base", "unknown_zone", None),
    ("york", "2025-11-05T12:34:10-05:00[America/Toronto]", "ok", utc(2025, 11, 5, 17, 34, 10)),
    ("plain", "2026-01-13 01:19:24 +0530", "ok", utc(2026, 1, 12, 19, 49, 24)),
    ("plain", "24-Nov-2025 22:06 GMT+5:30", "ok", utc(2025, 11, 24, 16, 36)),
    ("plain", "28 février 2025 à 20h28", "ok", utc(2025, 2, 28, 20, 28)),
    ("plain", "Sun, 31 May 2026 20:52:00 +0000", "ok", utc(2026, 5, 31, 20, 52)),
    ("plain", "Apr 5, 2025 4:11 PM PDT", "ok", utc(2025, 4, 5, 23, 11)),
    ("plain", "\t2026-03-28 11:02:25 ", "ok", utc(2026, 3, 28, 11, 2, 25)),
    ("plain", "20250717T153855Z", "ok", utc(2025, 7, 17, 15, 38, 55)),
    ("plain", "2026-06-10T21:03:04.310497354Z", "ok", utc(2026, 6, 10, 21, 3, 4, 310497)),
    ("plain", "2026-02-19T23:22:50,3Z", "ok", utc(2026, 2, 19, 23, 22, 50, 300000)),
    ("plain", "2025-12-29T04:51Z", "ok", utc(2025, 12, 29, 4, 51)),
    ("plain", "2025-09-26t09:21:26z", "ok", utc(2025, 9, 26, 9, 21, 26)),
    ("plain", "1762031772", "ok", 1762031772_000000),
    ("plain", "1789295052671", "ok", 1789295052671_000),
    ("plain", "1743105782910565", "ok", 1743105782910565),
    ("plain", "/Date(1745599379851)/", "ok", 1745599379851_000),
    ("plain", "20260828", "unreadable", None),
    ("plain", "2026-13-06 01:18:08", "unreadable", None),
    ("plain", "2025-02-30T06:36:00Z", "unreadable", None),
    ("plain", "2025-04-22T25:07:00Z", "unreadable", None),
    ("plain", "0000-00-00 00:00:00", "unreadable", None),
    ("plain", "2 days ago", "unreadable", None),
    ("plain", "16 Oct 2025", "unreadable", None),
    ("plain", "x" * 100_000, "unreadable", None),
    ("plain", "  ", "blank", None),
    ("plain", None, "blank", None),
    (None, "2025-01-01 00:00:00", "ok", utc(2025, 1, 1)),
    ("nobody", "2025-01-01 00:00:00", "ok", utc(2025, 1, 1)),
    ("nobody", "01/02/2025 10:00", "unreadable", None),
]


def test_notations_and_zones(spark):
    rows = [(i, s, t) for i, (s, t, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, source string, at string").selectExpr("*", "1 as raw", "'x' as status", "2 as _t")
    got = {r["id"]: (r["status"], r["utc_micros"]) for r in instants.normalize(df, "id", ["at"], "source", _sources(spark)).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != (c[2], c[3])]
    assert not wrong


def _sources(spark):
    return spark.createDataFrame(SOURCES, "source string, home_zone string, date_style string")


def test_repeats_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "plain", "1762031772")] * 2 + [(1, "plain", None)], "id long, source string, at string")
    assert sorted(r["status"] for r in instants.normalize(df, "id", ["at"], "source", _sources(spark)).collect()) == ["blank", "ok", "ok"]
    assert instants.normalize(df.limit(0), "id", ["at"], "source", _sources(spark)).count() == 0
    assert instants.normalize(df, "id", ["at"], "source", _sources(spark).limit(0)).filter("status = 'ok'").count() == 2


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Africa/Casablanca", "Australia/Lord_Howe", "UTC"])
def test_periods_agree_with_the_zone_database(zone):
    z, found = ZoneInfo(zone), zones.periods(zone, (2000, 2040))
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
    for start, end, offset in found:
        for at in (start, (start + end) // 2, end - 1):
            assert datetime.fromtimestamp(at, z).utcoffset().total_seconds() == offset


def test_counts_before_september_2001(spark):
    cases = [
        ("987654321", 987654321_000000), ("987654321012", 987654321_012000), ("987654321012345", 987654321_012345), ("987654321012345678", 987654321_012345),
        ("-987654321", -987654321_000000), ("987654321.25", 987654321_250000), ("/Date(202608081530)/", 202608081_530000), ("202608081530", None), ("202699991530", 202699991_530000), ("87654321", None),
    ]
    df = spark.createDataFrame([(i, "plain", t) for i, (t, _) in enumerate(cases)], "id long, source string, at string")
    got = {r["id"]: (r["status"], r["utc_micros"]) for r in instants.normalize(df, "id", ["at"], "source", _sources(spark)).collect()}
    assert [(c, got[i]) for i, c in enumerate(cases) if got[i] != ("ok" if c[1] is not None else "unreadable", c[1])] == []
