"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so fewer than 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001
LEAST_ROWS = 10_000


def join_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Inner join of ``left`` with at most one row of ``right`` per key; null keys are equal to null.

    ``rows`` is a column of ``right`` with the number of rows of ``left`` that have the key. Hot
    keys are broadcast, of which there are fewer than 1 / HOT_SHARE; the rest is an ordinary join.
    ``right`` is read three times and should be a table or cut from its lineage.
    """
    total = right.agg(F.sum(rows).alias("_total"))
    is_hot = (F.col(rows) > HOT_SHARE * F.col("_total")) & (F.col(rows) > LEAST_ROWS)
    marked = right.crossJoin(F.broadcast(total))  # one row
    hot = marked.filter(is_hot).drop("_total", rows)
    cold = marked.filter(~is_hot).drop("_total", rows)

    def on(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        renamed = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        condition = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
            condition = same if condition is None else condition & same
        return a.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])

    few = F.broadcast(hot)
    return on(left, few, "inner").unionByName(on(on(left, F.broadcast(hot.select(*keys)), "left_anti"), cold, "inner"))
