"""Files processed once per content version, oldest first, with data and checkpoint committed together."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.upsert import Store
from millrace.sources import listing

Process = Callable[[DataFrame, dict[str, DataFrame | None]], dict[str, DataFrame]]


def run(spark: SparkSession, folder: str, store: Store, columns: tuple[str, ...], process: Process, newest: int | None = None, first: date | None = None) -> list[str]:
    """Processes pending files one by one; returns their names.

    ``process`` gets a file's rows and the live tables and returns the tables to replace. They and
    the file's checkpoint row become live in one commit, so a retry never repeats or loses a file.
    The files of one call are a handful of names on the driver.
    """
    listed = listing.since(listing.retried(lambda: listing.files(spark, folder)), first)
    done = store.table("files")
    empty = spark.createDataFrame([], "path string, version string")
    todo = listing.pending(listed, empty if done is None else done.select("path", "version"), newest).collect()
    names = []
    for f in todo:
        rows = listing.scan(spark, [f["path"]], columns).withColumn("file_date", F.lit(f["file_date"]))
        tables = {n: store.table(n) for n in store.tables()}
        made = process(rows, tables)
        mark = spark.createDataFrame([(f["path"], f["version"], f["file_date"])], "path string, version string, file_date date")
        made["files"] = mark if tables.get("files") is None else tables["files"].unionByName(mark)
        store.commit(made)
        names.append(f["name"])
    return names
