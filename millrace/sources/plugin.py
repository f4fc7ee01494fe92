"""A Python data source that lists daily files, as the extension point for other sources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Names that one task looks up.
NAMES_PER_TASK = 500


def daily(name: str) -> date | None:
    """The date of a file named YYYY-MM-DD.parquet, None for other names and dates that don't exist."""
    found = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})\.parquet", name)
    try:
        return date(*map(int, found.groups())) if found else None
    except ValueError:
        return None


def _row(path: Path) -> tuple:
    size = path.stat().st_size if path.is_file() else sum(p.stat().st_size for p in path.rglob("*") if p.is_file())
    return str(path), path.name, size, daily(path.name)


class ListingSource(DataSource):
    """spark.read or readStream.format("daily_listing").option("path", folder): path, name, size, file_date.

    The folder must be mounted on every machine; on other file systems use ``listing.files``.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_listing"

    def schema(self) -> str:
        return "path string, name string, size long, file_date date"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", "."))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options.get("path", "."))


class Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        names = sorted(p.name for p in Path(self.folder).iterdir() if daily(p.name))
        return [Names(names[i : i + NAMES_PER_TASK]) for i in range(0, len(names), NAMES_PER_TASK)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        return (_row(Path(self.folder) / n) for n in partition.names)


class _Stream(SimpleDataSourceStreamReader):
    """New days in order; the offset is the last day that was given."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"day": ""}

    def _between(self, start: str, end: str | None) -> list[tuple]:
        rows = sorted((_row(p) for p in Path(self.folder).iterdir() if daily(p.name)), key=lambda r: r[3])
        return [r for r in rows if r[3].isoformat() > start and (end is None or r[3].isoformat() <= end)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._between(start["day"], None)
        return iter(rows), {"day": rows[-1][3].isoformat() if rows else start["day"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(start["day"], end["day"]))
