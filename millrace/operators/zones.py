"""Zone-offset intervals on the local time axis.

Every offset period [start, end) of a zone in UTC becomes the period [start + offset, end + offset)
of its wall clock. Consecutive periods overlap where clocks go back and leave a gap where they go
forward, so the number of periods that hold a wall-clock time tells whether it exists once, twice
or not at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import session

#: Years whose wall-clock times can be resolved; others are treated as impossible.
YEARS = (1970, 2100)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_STEP = 20 * 86_400  # seconds; shorter than the offset periods in the zone database since 1970
MICROS = 1_000_000
_KINDS = {"zone": pa.string(), "local_year": pa.int32(), "local_from": pa.int64(), "local_to": pa.int64(), "offset_s": pa.int32()}


def _year_start(year: int) -> int:
    return int((datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())


def periods(zone: str, years: tuple[int, int] = YEARS) -> list[tuple[int, int, int]]:
    """(start, end, offset) of each offset period in seconds of UTC, clipped to ``years`` and a margin."""
    z, at = ZoneInfo(zone), datetime.fromtimestamp
    first, stop = _year_start(years[0]) - 2 * _STEP, _year_start(years[1]) + 2 * _STEP
    marks = list(range(first, stop, _STEP))
    seen = [at(s, z).utcoffset() for s in marks]
    out, began = [], first
    for i in range(1, len(marks)):
        low, now = marks[i - 1], seen[i - 1]
        while now != seen[i]:  # again if the offset changes twice between two marks
            high = marks[i]
            while high - low > 1:
                mid = (low + high) // 2
                if at(mid, z).utcoffset() == now:
                    low = mid
                else:
                    high = mid
            out.append((began, high, int(now.total_seconds())))
            began, low, now = high, high, at(high, z).utcoffset()
    out.append((began, stop, int(seen[-1].total_seconds())))
    return out


def _rows(zones: Iterable[str], years: tuple[int, int]) -> list[tuple]:
    rows = []
    for zone in zones:
        for start, end, off in periods(zone, years):
            first, last = ((_EPOCH + timedelta(seconds=s + off)).year for s in (start, end - 1))
            for year in range(max(first, years[0]), min(last, years[1] - 1) + 1):
                rows.append((zone, year, (start + off) * MICROS, (end + off) * MICROS, off))
    return rows


def known_zones() -> frozenset[str]:
    return frozenset(z for z in available_timezones() if z not in ("localtime", "posixrules", "Factory"))


def intervals(spark: SparkSession, zones: frozenset[str], years: tuple[int, int] = YEARS) -> DataFrame:
    """zone, local_year, local_from, local_to (microseconds of wall clock), offset_s: one row per period and year it touches.

    The table is bounded by the zone database: at most some 600 zones times the years times two or three periods.
    """
    named = spark.createDataFrame([(z,) for z in sorted(zones)], "zone string").repartition(max(1, min(len(zones) // 16, 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*_rows(batch.column(0).to_pylist(), years))) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values())], list(_KINDS))

    return named.mapInArrow(run, "zone string, local_year int, local_from long, local_to long, offset_s int")


def grouped(spark: SparkSession, zones: frozenset[str], years: tuple[int, int] = YEARS) -> DataFrame:
    """The same with the periods of one zone and year in an array, so that a join keeps one row per value."""
    period = F.struct("local_from", "local_to", "offset_s")
    return intervals(spark, zones, years).groupBy("zone", "local_year").agg(F.collect_list(period).alias("periods"))


_kept: dict[str, DataFrame] = {}


def table(spark: SparkSession) -> DataFrame:
    """The grouped intervals of all known zones, written once per application to the shared checkpoint folder."""
    key = spark.sparkContext.applicationId
    if key not in _kept:
        _kept.clear()
        _kept[key] = session.cut(grouped(spark, known_zones()))
    return _kept[key]
