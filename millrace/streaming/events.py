"""Event-time operators that the listing engine itself lacks; they work on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, size: str, by: str, value: str, watermark: str | None = None) -> DataFrame:
    rows = df if watermark is None else df.withWatermark(at, watermark)
    out = rows.groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(df: DataFrame, at: str, size: str, step: str, watermark: str | None = None) -> DataFrame:
    rows = df if watermark is None else df.withWatermark(at, watermark)
    return rows.groupBy(F.window(at, size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(df: DataFrame, at: str, gap: str, by: str, watermark: str | None = None) -> DataFrame:
    rows = df if watermark is None else df.withWatermark(at, watermark)
    out = rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_key(df: DataFrame, key: str, at: str, watermark: str) -> DataFrame:
    """Each key once within the watermark; on a batch, once."""
    if df.isStreaming:
        return df.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])
