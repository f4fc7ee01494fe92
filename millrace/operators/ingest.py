"""Listings from a file to the stored tables: validate, locate, classify, date, key, match and load.

``prepare`` is one pass of column expressions and small joins; every refused row has its reasons.
``run`` prepares a batch, loads it into a ``Store`` and commits tables, ledger and counters together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import classify, dedupe, freshness, location, search, text
from millrace.operators import quality, upsert
from millrace.sources import listing


@dataclass(frozen=True)
class Settings:
    """What is let in. Empty lists let everything pass, 0 days is no limit."""

    countries: Sequence[str] = ("US",)
    categories: Sequence[str] = ()
    blocked: Sequence[str] = ()
    max_age_days: int = 0
    age_fallback: bool = True

    @staticmethod
    def parse(countries: str = "US", categories: str = "", blocked: str = "", **rest) -> Settings:
        """From comma-separated texts: countries in upper, categories in lower case; blanks are no entries."""
        cut = lambda t: tuple(x.strip() for x in t.split(",") if x.strip())
        return Settings(tuple(c.upper() for c in cut(countries)), tuple(c.lower() for c in cut(categories)), tuple(c.lower() for c in cut(blocked)), **rest)


#: Columns of a stored listing beside its id and the times that the load keeps.
COLUMNS = (
    "title", "title_key", "description_text", "company_external_id", "company_name", "country_code", "state_code", "city", "city_key", "postal_code", "remote_type", "employment_type",
    "seniority", "department", "salary_min", "salary_max", "salary_currency", "salary_interval", "posted_at", "posted_at_is_valid", "source_fetched_at", "close_at", "closed_at", "status",
    "apply_url", "apply_url_canonical", "l2", "l4", "content_hash", "category_slug", "seniority_level", "industry", "search_doc",
)
MATCHERS = (("l2", "L2_APPLY_URL"), ("l4", "L4_CONTENT_FINGERPRINT"))
KEEP_OLD = ("company_external_id", "company_name", "industry")


def lifecycle(raw_status: Column, closed_at: Column, close_at: Column, fetched_at: Column) -> Column:
    """struct<status, closed_at>: closed listings are EXPIRED and need a closure time, the fetch if the source gives none."""
    closed = F.coalesce(F.lower(raw_status) == "closed", F.lit(False))
    at = F.when(closed & closed_at.isNull() & close_at.isNull(), fetched_at).otherwise(closed_at)
    return F.struct(F.when(closed, "EXPIRED").otherwise("ACTIVE").alias("status"), F.when(closed, F.coalesce(at, close_at)).otherwise(at).alias("closed_at"))


def prepare(rows: DataFrame, companies: DataFrame, as_of: Column, settings: Settings = Settings(), cities: DataFrame | None = None, order: Sequence[str] = ("record_id",)) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): rows ready to load, and source, external_id, reason of every reason of every refused row.

    A date too far ahead or too early is a reason that refuses nothing: the row is kept and its date
    flagged. A repeated (source, external_id) is refused but for the first in order. ``rows`` have the
    columns of ``sources.listing.NORMALIZED``; the registry of companies is joined by its number.
    """
    c = F.col
    out = listing.with_registry(rows, companies.select("id", "country", "industry"), "company_external_id")
    out = out.withColumn("raw_workplace_type", listing.workplace(c("raw_workplace_type")))
    out = location.resolve(out, company_country="company_country", cities=cities)
    out = out.withColumns({
        "category_slug": classify.category(c("title"), c("department")), "seniority_level": classify.level(c("title"), c("seniority")),
        "dated": freshness.assess(c("posted_at"), as_of), "life": lifecycle(c("raw_status"), c("closed_at"), c("close_at"), c("source_fetched_at")),
        "pay": text.amounts_in_order(text.amount(c("salary_min")), text.amount(c("salary_max"))),
    })
    structural = quality.structural(c("external_id"), c("title"), c("company_external_id"), c("apply_url"), F.lit(True))
    gates = F.array_compact(F.array(
        quality.country_gate(c("where.country_code"), settings.countries),
        F.when(~F.coalesce(quality.scope_gate(c("category_slug"), settings.categories, settings.blocked), F.lit(True)), "CATEGORY_NOT_ALLOWED"),
        quality.age_gate(c("posted_at"), c("dated.valid"), as_of, settings.max_age_days, settings.age_fallback),
    ))
    # A row is refused by the first stage that objects: structure, place, age, then scope.
    out = out.withColumn("reasons", F.when(F.size(structural) > 0, structural).otherwise(F.slice(gates, 1, 1)))
    out = quality.repeats(out.withColumn("_ok", F.when(F.size("reasons") == 0, c("external_id"))), ["source", "_ok"], order)
    out = session.cut(out.withColumn("reasons", F.when(c("repeat"), F.array(F.lit("DUPLICATE_IN_BATCH"))).otherwise(c("reasons"))).drop("_ok", "repeat"))
    flagged = out.filter("size(reasons) = 0 and dated.reason is not null").select("source", "external_id", c("dated.reason").alias("reason"), F.lit(False).alias("refused"))
    refused = out.filter("size(reasons) > 0").select("source", "external_id", F.explode("reasons").alias("reason"), F.lit(True).alias("refused")).unionByName(flagged)
    good = out.filter("size(reasons) = 0").select(
        "source", "external_id", *order, F.substring("title", 1, 500).alias("title"), "description_text", "company_external_id", "company_name", "where.country_code", "where.state_code",
        "where.city", "where.city_key", "where.postal_code", "where.remote_type", text.first_prefix(c("raw_employment_type"), text.EMPLOYMENT, "OTHER", "UNKNOWN").alias("employment_type"),
        "seniority", "department", c("pay.low").alias("salary_min"), c("pay.high").alias("salary_max"), text.currency_code(c("salary_currency")).alias("salary_currency"),
        text.lookup(c("raw_salary_interval"), text.INTERVALS, "UNKNOWN").alias("salary_interval"), "posted_at", c("dated.valid").alias("posted_at_is_valid"), "source_fetched_at", "close_at",
        "life.closed_at", "life.status", "apply_url", "category_slug", "seniority_level", text.title_case(c("company_industry")).alias("industry"),
    )
    good = dedupe.with_keys(good, "source", "external_id", "apply_url", "company_name", "title", ("country_code", "state_code", "city_key"), "description_text")
    good = good.withColumnRenamed("canonical_url", "apply_url_canonical").withColumn("content_hash", dedupe.content_of())
    good = good.withColumn("search_doc", search.weighted_document(c("title"), c("department"), c("city"), c("description_text")))
    return good.select("source", "external_id", *order, *COLUMNS), refused


COUNTERS = ("accepted", "refused", "inserted", "merged", "updated", "unchanged")


def counters(accepted: DataFrame, refused: DataFrame, done: DataFrame) -> DataFrame:
    """One row: how many rows a run accepted and refused, and what became of the accepted ones."""
    counts = done.agg(F.count("*").alias("accepted"), *[F.count_if(F.col("action") == a).alias(a) for a in (upsert.INSERT, upsert.MERGE, upsert.UPDATE, upsert.TOUCH)])
    gone = refused.filter("refused").select("source", "external_id").distinct().agg(F.count("*").alias("refused"))
    return counts.crossJoin(gone).select(*COUNTERS)  # one row each


def load(tables: dict[str, DataFrame | None], accepted: DataFrame, as_of: Column, order: Sequence[str] = ("record_id",)) -> tuple[dict[str, DataFrame], upsert.Loaded]:
    """The tables jobs, job_sources, job_events, companies and locations after a batch, and the load itself.

    Companies and places that are not stored yet get ids; events go to the month they happened in.
    """
    made = upsert.load(tables.get("jobs"), tables.get("job_sources"), accepted, COLUMNS, matchers=MATCHERS, keep_old_if_null=KEEP_OLD, seen_at=as_of, order=order)
    events = made.events.withColumn("month", F.date_format("occurred_at", "yyyy-MM"))
    spark = accepted.sparkSession

    def dimension(name: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
        rows = accepted.filter(F.col(key[0]).isNotNull()).select(*key, *columns, *order)
        known = tables.get(name)
        if known is None:
            known = spark.createDataFrame([], rows.drop(*order).schema).withColumn("id", F.lit(None).cast("long"))
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = upsert.new_ids(upsert.missing_rows(known, rows, key, order).drop(*order), key, top)
        return known.unionByName(new)

    out = {
        "jobs": made.state, "job_sources": made.provenance, "job_events": events if tables.get("job_events") is None else tables["job_events"].unionByName(events),
        "companies": dimension("companies", ("source", "company_external_id"), ("company_name", "industry")),
        "locations": dimension("locations", ("country_code", "state_code", "city_key", "postal_code"), ("city",)),
    }
    return out, made


def run(store: upsert.Store, rows: DataFrame, companies: DataFrame, as_of: datetime, settings: Settings = Settings(), cities: DataFrame | None = None, order: Sequence[str] = ("record_id",)) -> dict[str, int]:
    """Prepares and loads one batch under the store's lock and commits everything at once; returns the counters.

    The ledger keeps exact counts per reason of every run. A run that fails leaves the old version.
    """
    store.begin()
    try:
        at = F.lit(as_of).cast("timestamp")
        accepted, refused = prepare(rows, companies, at, settings, cities, order)
        accepted = session.cut(accepted)
        tables = {n: store.table(n) for n in store.tables()}
        after, made = load(tables, accepted, at, order)
        counts = session.cut(counters(accepted, refused, made.rows).withColumn("started_at", at).withColumn("status", F.lit("SUCCEEDED")))
        ledger = quality.ledger(refused, "reason").withColumn("occurred_at", at)
        for name, new in (("runs", counts), ("rejections", ledger)):
            after[name] = new if tables.get(name) is None else tables[name].unionByName(new)
        store.commit(after, {"job_events": ["month"]})
        return {c: counts.first()[c] for c in COUNTERS}
    finally:
        store.end()
