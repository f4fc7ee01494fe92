"""Validation of rows, gates, and a bounded record of what was refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def structural(external_id: Column, title: Column, company: Column, url: Column, readable: Column) -> Column:
    """What is missing or broken in a listing."""
    address = clean(url)
    return reasons(
        (clean(external_id).isNull(), "MISSING_EXTERNAL_ID"), (clean(title).isNull(), "MISSING_TITLE"), (clean(company.cast("string")).isNull(), "MISSING_COMPANY"),
        (address.isNull(), "MISSING_APPLY_URL"), (address.isNotNull() & ~address.rlike("(?i)^https?://[^/?#]+"), "INVALID_URL"), (~F.coalesce(readable, F.lit(False)), "UNPARSEABLE_PAYLOAD"),
    )


def country_gate(country: Column, allowed: Sequence[str]) -> Column:
    """Null and other countries are refused; an empty list lets all pass."""
    return F.when(country.isNull(), "INVALID_COUNTRY").when(~country.isin(*allowed), "COUNTRY_NOT_ALLOWED") if allowed else F.lit(None).cast("string")


def scope_gate(category: Column, allowed: Sequence[str] = (), blocked: Sequence[str] = ()) -> Column:
    """Whether a category is wanted; a blocked one never is."""
    inside = category.isin(*allowed) if allowed else F.lit(True)
    return inside & ~category.isin(*blocked) if blocked else inside


def age_gate(posted_at: Column, valid: Column, as_of: Column, days: int, fallback: bool = True) -> Column:
    """TOO_OLD beyond so many days; a row without a valid date counts as new or, without the fallback, as too old. 0 is off."""
    if days <= 0:
        return F.lit(None).cast("string")
    at = F.coalesce(F.when(valid, posted_at), as_of if fallback else F.lit(None).cast("timestamp"))
    return F.when(at.isNull() | (at < as_of - F.make_dt_interval(days=F.lit(days))), "TOO_OLD")


def split(df: DataFrame, column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and one row per row and reason."""
    return df.filter(F.size(column) == 0), df.filter(F.size(column) > 0).withColumn("reason", F.explode(column))


def repeats(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``repeat``: false for the first row of a key in order, true for the others; rows with a null key are no repeats."""
    w = Window.partitionBy(*key).orderBy(*order)
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return df.withColumn("repeat", known & (F.row_number().over(w) > 1))


def breakdown(ledgers: DataFrame, by: Sequence[str] = ("reason",), top: int = 20) -> DataFrame:
    """The most frequent reasons over the ledgers of all runs, or per run if ``by`` names it: ``by`` and n (a top-k report)."""
    counts = ledgers.groupBy(*by).agg(F.sum(F.col("kept") + F.col("overflow")).alias("n"))
    return counts.orderBy(F.desc("n"), *by).limit(top)


def ledger(refused: DataFrame, reason: str, examples: int = 100) -> DataFrame:
    """Exact counts per reason with a bounded number of examples kept (``samples`` gives these): reason, kept, overflow."""
    counts = refused.groupBy(reason).agg(F.count("*").alias("n"))
    return counts.select(reason, F.least("n", F.lit(examples)).alias("kept"), F.greatest(F.col("n") - examples, F.lit(0)).alias("overflow"))


def samples(refused: DataFrame, reason: str, order: Sequence[str], examples: int = 100) -> DataFrame:
    """The examples themselves: the first of each reason in order (the limit is the feature)."""
    w = Window.partitionBy(reason).orderBy(*order)
    return refused.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= examples).drop("_n")


#: Constraints of stored listings: (name, condition that a good row fulfils).
def listing_constraints() -> dict[str, Column]:
    c = F.col
    return {
        "salary_order": c("salary_min").isNull() | c("salary_max").isNull() | (c("salary_min") <= c("salary_max")),
        "salary_sign": (F.coalesce(c("salary_min"), F.lit(0)) >= 0) & (F.coalesce(c("salary_max"), F.lit(0)) >= 0),
        "country_form": c("country_code").isNull() | c("country_code").rlike("^[A-Z]{2}$"),
        "currency_form": c("salary_currency").isNull() | c("salary_currency").rlike("^[A-Z]{3}$"),
        "valid_has_date": ~c("posted_at_is_valid") | c("posted_at").isNotNull(),
        "expired_has_closure": (c("status") != "EXPIRED") | c("closed_at").isNotNull(),
    }


def violations(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """One row per row and broken constraint."""
    return df.withColumn("violation", F.explode(reasons(*[(~F.coalesce(ok, F.lit(True)), n) for n, ok in constraints.items()])))
