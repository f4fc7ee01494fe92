"""Text that may encode JSON, once or several times, and its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean


def decoded(text: Column, depth: int = 3) -> Column:
    """The object that a text encodes, as a variant, through at most ``depth`` layers; null for anything else.

    For one use of the result; ``with_decoded`` keeps it as a column.
    """
    v = F.try_parse_json(text)
    for _ in range(depth - 1):
        v = F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def with_decoded(df: DataFrame, name: str, source: Column, depth: int = 3, parsed: bool = False) -> DataFrame:
    """Adds ``name``: the object that ``source`` encodes, through at most ``depth`` layers of text; null for anything else.

    ``source`` is a text, or a variant if it is ``parsed``. Every layer is a column of its own, so no text is parsed twice.
    """
    layer = [f"_{name}_{i}" for i in range(depth + 1)]
    out = df.withColumn(layer[0], source if parsed else F.try_parse_json(source))
    for before, now in zip(layer, layer[1:] if parsed else layer[1:-1]):
        out = out.withColumn(now, F.when(F.schema_of_variant(before) == "STRING", F.try_parse_json(F.try_variant_get(before, "$", "string"))).otherwise(F.col(before)))
    last = layer[-1] if parsed else layer[-2]
    return out.withColumn(name, F.when(F.schema_of_variant(last).startswith("OBJECT"), F.col(last))).drop(*layer)


def member(value: Column, path: str, kind: str = "string") -> Column:
    """A member by path, null where the path leads nowhere or to another type."""
    return F.try_variant_get(value, path, kind)


def boolean(text: Column) -> Column:
    t = F.lower(clean(text))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def number(text: Column) -> Column:
    """A finite double; null for words, booleans, not-a-number and infinities."""
    d = clean(text).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def instant(text: Column) -> Column:
    """An ISO-8601 date or time; no zone means UTC. A bare year or month is none."""
    t = clean(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


def envelope(text: Column, most: int = 8000) -> Column:
    """Longer payloads as an object that says so, with their length and beginning; for logs of rejected rows."""
    cut = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.length(text).alias("_original_chars"), F.substring(text, 1, most).alias("_preview")))
    return F.when(F.length(text) > most, cut).otherwise(text)
