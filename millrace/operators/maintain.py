"""Retention, purge, backfills and orphan clean-up as single rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.feed import not_among


def age_of(posted_at: Column, valid: Column, first_seen: Column) -> Column:
    return F.coalesce(F.when(valid, posted_at), first_seen)


def expire(df: DataFrame, old: Column, now: Column) -> DataFrame:
    """Old rows become EXPIRED with a closure time; nothing is deleted."""
    hit = old & (F.col("status") != "EXPIRED")
    return df.withColumn("closed_at", F.when(hit, F.coalesce("closed_at", now)).otherwise(F.col("closed_at"))).withColumn("status", F.when(hit, "EXPIRED").otherwise(F.col("status")))


def keep(df: DataFrame, old: Column) -> DataFrame:
    """Rows that are not old; a row of unknown age stays."""
    return df.filter(~F.coalesce(old, F.lit(False)))


def preview(df: DataFrame, old: Column, dated: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(old).alias("out_of_window"), F.count_if(old & ~dated).alias("out_without_date"))


def purge(df: DataFrame, category: str, wanted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the rows by category that go, for a dry run."""
    gone = not_among(F.col(category), wanted)
    return df.filter(~gone), df.filter(gone).groupBy(F.coalesce(category, F.lit("(none)")).alias("category")).agg(F.count("*").alias("n"))


def purge_report(df: DataFrame, category: str, wanted: Sequence[str], categories: DataFrame) -> DataFrame:
    """(slug, name, n): the rows that a purge removes, by category with its name; one that is unknown or null has none."""
    gone = df.filter(not_among(F.col(category), wanted)).groupBy(F.col(category).alias("slug")).agg(F.count("*").alias("n"))
    return gone.join(categories.select("slug", "name"), "slug", "left").select(F.coalesce("slug", F.lit("(none)")).alias("slug"), "name", "n")


def checked_window(days: int, retention_days: int, kept: int) -> None:
    """Refuses a purge whose window is off or within the retention, or that would leave nothing."""
    if days <= 0 or days <= retention_days:
        raise ValueError(f"a window of {days} days is not longer than the retention of {retention_days}")
    if kept == 0:
        raise ValueError("the purge would leave no row")


def retention(tables: dict[str, DataFrame], now: Column, days: int, delete: bool = False, keep_errors_days: int = 14) -> dict[str, DataFrame]:
    """The tables jobs, job_sources, job_events and errors after retention: old listings expire or, if asked, go with all that hangs on them; old errors go.

    0 days is off: then only errors are trimmed. Tables that aren't given stay away.
    """
    out = dict(tables)
    if days > 0:
        old = age_of(F.col("posted_at"), F.col("posted_at_is_valid"), F.col("first_seen_at")) < now - F.make_dt_interval(days=F.lit(days))
        out["jobs"] = keep(tables["jobs"], old) if delete else expire(tables["jobs"], old, now)
        if delete:
            out |= {n: without_orphans(tables[n], "job_id", out["jobs"], "job_id") for n in ("job_sources", "job_events") if n in tables}
    if "errors" in tables:
        out["errors"] = trim(tables["errors"], "occurred_at", now, keep_errors_days)
    return out


def trim(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days; a row without a time stays."""
    return df.filter(~F.coalesce(F.col(at) < now - F.make_dt_interval(days=F.lit(days)), F.lit(False)))


def reclassify(df: DataFrame, category: Column, level: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with category_slug and seniority_level worked out again, and (old, new, n): how many rows moved between which categories."""
    made = df.withColumn("_category", category).withColumn("_level", level)
    moved = made.filter(~F.col("category_slug").eqNullSafe(F.col("_category"))).groupBy(F.col("category_slug").alias("old"), F.col("_category").alias("new")).agg(F.count("*").alias("n"))
    return made.withColumn("category_slug", F.col("_category")).withColumn("seniority_level", F.col("_level")).drop("_category", "_level"), moved


def remap(df: DataFrame, column: str, affected: Sequence[str], text: Column, rules: Sequence[tuple[str, str]], other: str) -> DataFrame:
    """Splits old values of a column: rows that have one of ``affected`` get the value of the first pattern found in ``text``, else ``other``."""
    chain = None
    for value, pattern in rules:
        chain = F.when(text.rlike("(?iu)" + pattern), value) if chain is None else chain.when(text.rlike("(?iu)" + pattern), value)
    new = F.lit(other) if chain is None else chain.otherwise(other)
    return df.withColumn(column, F.when(F.col(column).isin(*affected), new).otherwise(F.col(column)))


def without_orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_semi")


def refresh(df: DataFrame, key: str, news: DataFrame, news_key: str, columns: Sequence[str]) -> DataFrame:
    """Columns updated from another table where it has a value that differs; ``news`` has one row per key."""
    other = news.select(F.col(news_key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(other, F.col(key) == F.col("_k"), "left").drop("_k")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return out.drop(*[f"_new_{c}" for c in columns])


def reclaim(runs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Runs that began too long ago and never ended are failed."""
    stale = F.col("status").isin("PENDING", "RUNNING") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status"))).withColumn("finished_at", F.when(stale, now).otherwise(F.col("finished_at")))


def staleness(runs: DataFrame, now: Column, hours: int = 26) -> DataFrame:
    """Hours since the last success and whether that is FRESH, STALE or NEVER."""
    last = runs.agg(F.max(F.when(F.col("status") == "SUCCEEDED", F.col("finished_at"))).alias("last_success"))
    age = F.timestamp_diff("HOUR", F.col("last_success"), now)
    return last.select("last_success", age.alias("hours"), F.when(F.col("last_success").isNull(), "NEVER").when(age > hours, "STALE").otherwise("FRESH").alias("state"))
