"""Queries of the listing engine's own operators on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classify, dedupe, freshness, jsonx, location, search, text, urls
from millrace.operators import feed, maintain, quality, upsert
from millrace.session import table
from millrace.sources import listing
from millrace.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Queries that depend on the time take this one, never the clock.
AS_OF = datetime(2026, 6, 15, 12, 0, 0, tzinfo=timezone.utc)
_AS_OF = "TIMESTAMPTZ '2026-06-15 12:00:00+00'"
PAGE = (feed.Sort("posted", "posted_at"), feed.Sort("first_seen", "first_seen_at"), feed.Sort("salary", "salary_max"), feed.Sort("relevance", None, keyset=False))


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(f"{name}_us")


# --- pages and filters

def _with_company(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    companies = table(spark, d, "companies").select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return df.join(companies, "company_id", "left")


_US_ACTIVE = feed.Filters(equal={"country_code": "US", "status": "ACTIVE"})
_PAGE_SQL = """
    SELECT j.job_id, j.title, c.name AS company_name, epoch_us(j.posted_at) AS posted_at_us
    FROM jobs j LEFT JOIN companies c ON c.id = j.company_id WHERE j.country_code = 'US' AND j.status = 'ACTIVE' {0}
    ORDER BY {1} DESC NULLS LAST, j.job_id DESC LIMIT 21
"""


def _page(spark: SparkSession, d: str, sort: str, cursor: feed.Cursor | None = None, filters: feed.Filters = _US_ACTIVE) -> DataFrame:
    rows = feed.page(table(spark, d, "jobs").filter(feed.predicate(filters)), sort, "job_id", 20, cursor)
    return _with_company(rows, spark, d).select("job_id", "title", "company_name", micros("posted_at"))


@query(_PAGE_SQL.format("", "j.posted_at"))
def feed_page_first(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "posted_at")


@query(_PAGE_SQL.format(f"AND (j.posted_at < {_AS_OF} OR (j.posted_at = {_AS_OF} AND j.job_id < 500) OR j.posted_at IS NULL)", "j.posted_at"))
def feed_page_next(spark: SparkSession, d: str) -> DataFrame:
    text_ = feed.encode_cursor(feed.Cursor("posted", AS_OF, 500))
    return _page(spark, d, "posted_at", feed.decode_cursor(text_, "posted"))


@query(_PAGE_SQL.format("AND j.posted_at IS NULL AND j.job_id < 100000", "j.posted_at"))
def feed_page_undated(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "posted_at", feed.Cursor("posted", None, 100000))


@query(_PAGE_SQL.format("", "j.salary_max"))
def feed_sort_salary(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, feed.sort_of("salary", PAGE).column)


@query(_PAGE_SQL.format("", "j.first_seen_at"))
def feed_sort_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, feed.sort_of("first_seen", PAGE).column)


@query("SELECT job_id, category_slug, remote_type FROM jobs WHERE category_slug IN ('data', 'software') AND remote_type IN ('REMOTE', 'HYBRID') AND employment_type IN ('FULL_TIME')")
def filter_multi_value(spark: SparkSession, d: str) -> DataFrame:
    f = feed.Filters(among={"category_slug": ["data", "software"], "remote_type": ["REMOTE", "HYBRID"], "employment_type": ["FULL_TIME"], "seniority_level": []})
    return table(spark, d, "jobs").filter(feed.predicate(f)).select("job_id", "category_slug", "remote_type")


@query("SELECT job_id, city FROM jobs WHERE city ILIKE 'port%'")
def filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").filter(feed.predicate(feed.Filters(begins={"city": "PORT"}))).select("job_id", "city")


@query("SELECT id, name FROM companies WHERE name ILIKE '%media%'")
def filter_substring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").filter(feed.predicate(feed.Filters(holds={"name": "Media"}))).select("id", "name")


@query(f"SELECT job_id, CAST(salary_max AS DOUBLE) AS salary_max FROM jobs WHERE salary_max >= 100000 AND posted_at >= {_AS_OF} - INTERVAL 30 DAY AND posted_at_is_valid")
def filter_range_flagged(spark: SparkSession, d: str) -> DataFrame:
    start = feed.within(None, 24 * 30, AS_OF)
    f = feed.Filters(at_least={"salary_max": 100000}, since={"posted_at": start}, flags=["posted_at_is_valid"])
    return table(spark, d, "jobs").filter(feed.predicate(f)).select("job_id", F.col("salary_max").cast("double").alias("salary_max"))


@query("SELECT p_partkey, p_brand FROM part WHERE nullif(p_brand, 'Brand#11') IS NULL OR NOT (p_brand IN ('Brand#12', 'Brand#13'))")
def not_in_keeps_null(spark: SparkSession, d: str) -> DataFrame:
    brand = F.nullif(F.col("p_brand"), F.lit("Brand#11"))
    return table(spark, d, "part").filter(feed.not_among(brand, ["Brand#12", "Brand#13"])).select("p_partkey", "p_brand")


# --- counts

@query(f"""SELECT count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (remote_type = 'REMOTE') AS remote,
    count(*) FILTER (salary_max IS NOT NULL) AS with_pay, count(*) FILTER (posted_at_is_valid AND posted_at >= {_AS_OF} - INTERVAL 24 HOUR) AS posted_24h,
    count(*) FILTER (posted_at_is_valid AND posted_at >= {_AS_OF} - INTERVAL 168 HOUR) AS posted_7d, count(*) FILTER (first_seen_at >= {_AS_OF} - INTERVAL 24 HOUR) AS found_24h,
    count(DISTINCT company_id) AS companies FROM jobs WHERE country_code = 'US'""")
def stats_conditional(spark: SparkSession, d: str) -> DataFrame:
    posted = feed.windows("posted_at", as_of(), {"posted_24h": 24, "posted_7d": 168})
    found = feed.windows("first_seen_at", as_of(), {"found_24h": 24})
    counts = {"active": F.col("status") == "ACTIVE", "remote": F.col("remote_type") == "REMOTE", "with_pay": F.col("salary_max").isNotNull()}
    counts |= {k: F.col("posted_at_is_valid") & v for k, v in posted.items()} | found
    return feed.counters(table(spark, d, "jobs").filter("country_code = 'US'"), counts, {"companies": "company_id"})


@query("SELECT (SELECT count(*) FROM jobs) AS n_jobs, (SELECT max(source_count) FROM jobs) AS most_sources, (SELECT count(*) FROM companies) AS n_companies")
def stats_scalars(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").agg(F.count("*").alias("n_jobs"), F.max("source_count").alias("most_sources"))
    return jobs.crossJoin(table(spark, d, "companies").agg(F.count("*").alias("n_companies")))  # one row each


@query("SELECT n.n_name, count(c.c_custkey) AS n FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900 GROUP BY n.n_name")
def facet_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    return feed.facet_of_all(table(spark, d, "nation"), "n_nationkey", table(spark, d, "customer"), "c_nationkey", F.col("c_acctbal") > 9900).select("n_name", "n")


_FACETS = feed.Filters(equal={"country_code": "US", "status": "ACTIVE"}, among={"category_slug": ["data", "software"], "remote_type": ["REMOTE"]})


@query("SELECT category_slug, count(*) AS n FROM jobs WHERE country_code = 'US' AND status = 'ACTIVE' AND remote_type = 'REMOTE' AND category_slug IS NOT NULL GROUP BY 1")
def facet_self_excluding(spark: SparkSession, d: str) -> DataFrame:
    return feed.facet(table(spark, d, "jobs"), "category_slug", _FACETS)


@query("SELECT seniority_level, count(*) AS n FROM jobs WHERE country_code = 'US' AND status = 'ACTIVE' AND category_slug IN ('data', 'software') AND remote_type = 'REMOTE' AND seniority_level IS NOT NULL GROUP BY 1")
def facet_seniority(spark: SparkSession, d: str) -> DataFrame:
    return feed.facet(table(spark, d, "jobs"), "seniority_level", _FACETS)


@query("SELECT industry, count(*) AS n FROM companies WHERE industry IS NOT NULL GROUP BY 1 ORDER BY n DESC, industry LIMIT 30")
def facet_top(spark: SparkSession, d: str) -> DataFrame:
    return feed.facet(table(spark, d, "companies"), "industry", feed.Filters(), top=30)


@query("SELECT state_code, count(*) AS n FROM jobs WHERE status = 'ACTIVE' AND country_code = 'US' AND state_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, state_code LIMIT 60")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return feed.facet(table(spark, d, "jobs"), "state_code", _US_ACTIVE, top=60)


@query("""SELECT c.id, c.name, count(*) FILTER (j.status = 'ACTIVE') AS active, count(*) AS total FROM companies c JOIN jobs j ON j.company_id = c.id
    GROUP BY c.id, c.name ORDER BY active DESC, total DESC, c.name, c.id LIMIT 20 OFFSET 5""")
def directory_counts(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "companies").select("id", "name")
    return feed.directory(owners, "id", table(spark, d, "jobs"), "company_id", F.col("status") == "ACTIVE", "name", offset=5).select("id", "name", "active", "total")


@query("SELECT count(DISTINCT c.id) AS n FROM companies c JOIN jobs j ON j.company_id = c.id")
def directory_total(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "jobs").select(F.col("company_id").alias("id"))
    return table(spark, d, "companies").join(used, "id", "left_semi").agg(F.countDistinct("id").alias("n"))


@query("SELECT j.job_id, j.title, (SELECT count(*) FROM job_sources s WHERE s.job_id = j.job_id) AS n_sources FROM jobs j")
def detail_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return feed.child_counts(table(spark, d, "jobs"), "job_id", table(spark, d, "job_sources").withColumnRenamed("job_id", "_job"), "_job", "n_sources").select("job_id", "title", "n_sources")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return feed.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT source, arg_max(source_path, (source_path, record_id)) AS source_path FROM normalized_jobs GROUP BY source")
def latest_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_jobs").groupBy("source").agg(F.max_by("source_path", F.struct("source_path", "record_id")).alias("source_path"))


_PROFILED = (
    "source", "external_id", "title", "company_name", "company_external_id", "description_text", "department", "seniority", "raw_country", "raw_state", "raw_city", "raw_postal_code", "raw_location_text",
    "raw_workplace_type", "source_is_remote", "raw_employment_type", "salary_min", "salary_max", "salary_currency", "raw_salary_interval", "posted_at", "source_fetched_at", "close_at", "closed_at",
    "apply_url", "raw_status", "ats_provider", "source_path",
)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS "values", round(100.0 * count({c}) / count(*), 1) AS coverage FROM normalized_jobs""" for c in _PROFILED))
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return feed.profile(table(spark, d, "normalized_jobs"), _PROFILED)


_FREQUENT = ("source", "seniority", "raw_country", "raw_employment_type")


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM normalized_jobs WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 5)""" for c in _FREQUENT))
def frequent_values(spark: SparkSession, d: str) -> DataFrame:
    return feed.frequent(table(spark, d, "normalized_jobs"), _FREQUENT)


@query(f"""SELECT unnest(['missing_columns', 'other_types', 'rows', 'repeated_ids', 'null_ids', 'ahead_of_time']) AS "check", unnest([1, 1, count(*), count(external_id) - count(DISTINCT external_id), count(*) FILTER (external_id IS NULL), count(*) FILTER (posted_at > {_AS_OF})]) AS n FROM normalized_jobs""")
def source_probe(spark: SparkSession, d: str) -> DataFrame:
    promised = {"external_id": "string", "title": "string", "posted_at": "timestamp", "salary_min": "double", "skills": "array<string>"}
    return feed.probe(table(spark, d, "normalized_jobs"), promised, "external_id", "posted_at", as_of())


# --- validation, ledger, gates

def _reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_jobs")
    made = quality.structural(F.col("external_id"), F.col("title"), F.col("company_external_id"), F.col("apply_url"), F.lit(True))
    return rows.withColumn("reasons", made)


_REASON_SQL = r"""(SELECT record_id, unnest([x FOR x IN [
        CASE WHEN trim(coalesce(external_id, '')) = '' THEN 'MISSING_EXTERNAL_ID' END, CASE WHEN trim(coalesce(title, '')) = '' THEN 'MISSING_TITLE' END,
        CASE WHEN trim(coalesce(company_external_id, '')) = '' THEN 'MISSING_COMPANY' END, CASE WHEN trim(coalesce(apply_url, '')) = '' THEN 'MISSING_APPLY_URL' END,
        CASE WHEN trim(coalesce(apply_url, '')) <> '' AND NOT regexp_matches(trim(apply_url), '(?i)^https?://[^/?#]+') THEN 'INVALID_URL' END] IF x IS NOT NULL]) AS reason FROM normalized_jobs)"""


@query(f"SELECT reason, count(*) AS n FROM {_REASON_SQL} GROUP BY reason ORDER BY n DESC, reason LIMIT 20")
def reject_breakdown(spark: SparkSession, d: str) -> DataFrame:
    _, refused = quality.split(_reasons(spark, d))
    return refused.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(20)


@query(f"SELECT reason, least(count(*), 100) AS kept, greatest(count(*) - 100, 0) AS overflow FROM {_REASON_SQL} GROUP BY reason")
def reject_ledger(spark: SparkSession, d: str) -> DataFrame:
    _, refused = quality.split(_reasons(spark, d))
    return quality.ledger(refused, "reason")


@query(f"SELECT reason, record_id FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY record_id) AS k FROM {_REASON_SQL}) WHERE k <= 100")
def reject_samples(spark: SparkSession, d: str) -> DataFrame:
    _, refused = quality.split(_reasons(spark, d))
    return quality.samples(refused, "reason", ["record_id"]).select("reason", "record_id")


@query("""SELECT record_id FROM (SELECT record_id, external_id, row_number() OVER (PARTITION BY source, external_id ORDER BY record_id) AS k FROM normalized_jobs) WHERE k > 1 AND external_id IS NOT NULL""")
def first_in_batch(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeats(table(spark, d, "normalized_jobs"), ["source", "external_id"], ["record_id"]).filter("repeat").select("record_id")


@query(f"""SELECT job_id, CASE WHEN country_code IS NULL THEN 'INVALID_COUNTRY' WHEN country_code NOT IN ('US', 'CA') THEN 'COUNTRY_NOT_ALLOWED' END AS country_reason,
    coalesce(category_slug IN ('data', 'software', 'sales') AND category_slug NOT IN ('sales'), false) AS in_scope,
    CASE WHEN coalesce(CASE WHEN posted_at_is_valid THEN posted_at END, {_AS_OF}) < {_AS_OF} - INTERVAL 60 DAY THEN 'TOO_OLD' END AS age_reason FROM jobs""")
def gates(spark: SparkSession, d: str) -> DataFrame:
    scope = quality.scope_gate(F.col("category_slug"), ["data", "software", "sales"], ["sales"])
    return table(spark, d, "jobs").select(
        "job_id", quality.country_gate(F.col("country_code"), ["US", "CA"]).alias("country_reason"), F.coalesce(scope, F.lit(False)).alias("in_scope"),
        quality.age_gate(F.col("posted_at"), F.col("posted_at_is_valid"), as_of(), 60).alias("age_reason"),
    )


@query("""SELECT violation, count(*) AS n FROM (SELECT unnest([x FOR x IN [CASE WHEN salary_min > salary_max THEN 'salary_order' END, CASE WHEN salary_min < 0 OR salary_max < 0 THEN 'salary_sign' END,
    CASE WHEN NOT regexp_full_match(country_code, '[A-Z]{2}') THEN 'country_form' END, CASE WHEN NOT regexp_full_match(salary_currency, '[A-Z]{3}') THEN 'currency_form' END,
    CASE WHEN posted_at_is_valid AND posted_at IS NULL THEN 'valid_has_date' END, CASE WHEN status = 'EXPIRED' AND closed_at IS NULL THEN 'expired_has_closure' END] IF x IS NOT NULL]) AS violation
    FROM (SELECT salary_max AS salary_min, salary_min AS salary_max, lower(country_code) AS country_code, lower(salary_currency) AS salary_currency, posted_at, NOT posted_at_is_valid AS posted_at_is_valid,
        CASE status WHEN 'EXPIRED' THEN 'ACTIVE' ELSE 'EXPIRED' END AS status, closed_at FROM jobs UNION ALL
        SELECT salary_min, salary_max, country_code, salary_currency, posted_at, posted_at_is_valid, status, closed_at FROM jobs)) GROUP BY 1""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """All jobs as stored, which hold, and once more with everything turned round, so that every constraint has rows to find."""
    jobs = table(spark, d, "jobs").select("salary_min", "salary_max", "country_code", "salary_currency", "posted_at", "posted_at_is_valid", "status", "closed_at")
    turned = jobs.select(
        F.col("salary_max").alias("salary_min"), F.col("salary_min").alias("salary_max"), F.lower("country_code").alias("country_code"), F.lower("salary_currency").alias("salary_currency"), "posted_at",
        (~F.col("posted_at_is_valid")).alias("posted_at_is_valid"), F.when(F.col("status") == "EXPIRED", "ACTIVE").otherwise("EXPIRED").alias("status"), "closed_at",
    )
    return quality.violations(turned.union(jobs), quality.listing_constraints()).groupBy("violation").agg(F.count("*").alias("n"))


# --- joins

@query("""WITH f AS (SELECT source_path AS path, CAST(epoch_us(max(source_fetched_at)) AS VARCHAR) AS version, CAST(epoch_us(min(source_fetched_at)) AS VARCHAR) AS done FROM normalized_jobs GROUP BY 1)
    SELECT path, version FROM f WHERE coalesce(version, '') <> coalesce(done, '')""")
def anti_pending(spark: SparkSession, d: str) -> DataFrame:
    """Files whose version (their last fetch) isn't the one recorded as done (their first)."""
    at = F.unix_micros("source_fetched_at")
    files = table(spark, d, "normalized_jobs").groupBy(F.col("source_path").alias("path")).agg(F.max(at).cast("string").alias("version"), F.min(at).cast("string").alias("_first"))
    files = files.withColumn("file_date", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))
    return listing.pending(files, files.select("path", F.col("_first").alias("version"))).select("path", "version")


@query("SELECT source_row_id FROM job_sources s WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = s.job_id)")
def orphans_removed(spark: SparkSession, d: str) -> DataFrame:
    return maintain.without_orphans(table(spark, d, "job_sources"), "job_id", table(spark, d, "jobs"), "job_id").select("source_row_id")


@query(r"""WITH f AS (SELECT DISTINCT source, CAST(regexp_extract(source_path, '(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS day FROM normalized_jobs),
    e AS (SELECT source, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM f GROUP BY source)
    SELECT source, strftime(CAST(e.day AS DATE), '%Y-%m-%d') AS file_date FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = e.source AND f.day = CAST(e.day AS DATE))""")
def gap_dates(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "normalized_jobs").select("source", F.regexp_extract("source_path", r"(\d{4}-\d{2}-\d{2})", 1).cast("date").alias("file_date"))
    return listing.gaps(days, by=["source"]).select("source", F.col("file_date").cast("string").alias("file_date"))


@query("""SELECT n.record_id, c.name AS company_name, c.industry AS company_industry FROM normalized_jobs n LEFT JOIN companies c ON c.id = TRY_CAST(n.company_external_id AS BIGINT)""")
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    companies = table(spark, d, "companies").select("id", "name", "industry")
    return listing.with_registry(table(spark, d, "normalized_jobs").select("record_id", "company_external_id"), companies, "company_external_id").select("record_id", "company_name", "company_industry")


@query("""SELECT s.s_suppkey, coalesce(CASE WHEN n.n_regionkey = 1 THEN n.n_name END, s.s_name) AS s_name, CASE WHEN n.n_regionkey = 1 AND n.n_name IS DISTINCT FROM s.s_name THEN 1 ELSE 0 END AS changed
    FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_name").alias("old"))
    news = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 1, F.col("n_name")).alias("s_name"))
    out = maintain.refresh(old, "s_nationkey", news, "n_nationkey", ["s_name"])
    return out.select("s_suppkey", "s_name", feed.changed(F.col("old"), F.col("s_name")).cast("int").alias("changed"))


# --- loading

@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1000 AS id FROM orders")
def identity_assignment(spark: SparkSession, d: str) -> DataFrame:
    return upsert.new_ids(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


@query("""SELECT job_id, CASE WHEN status = 'EXPIRED' AND job_id % 2 = 0 THEN 'EXPIRED' WHEN status = 'ACTIVE' AND job_id % 2 = 1 THEN 'REACTIVATED' WHEN job_id % 3 = 0 THEN 'UPDATED' END AS event
    FROM (SELECT job_id, status FROM jobs)""")
def event_derivation(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("job_id") % 2 == 1
    made = upsert.event(F.when(F.col("job_id") % 3 == 0, upsert.UPDATE).otherwise(upsert.TOUCH), F.when(odd, "EXPIRED").otherwise("ACTIVE"), F.col("status"))
    return table(spark, d, "jobs").select("job_id", made.alias("event"))


@query("SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL")
def month_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


# --- maintenance

_OLD_SQL = f"coalesce(CASE WHEN posted_at_is_valid THEN posted_at END, first_seen_at) < {_AS_OF} - INTERVAL 180 DAY"


def _old() -> Column:
    return maintain.age_of(F.col("posted_at"), F.col("posted_at_is_valid"), F.col("first_seen_at")) < as_of() - F.expr("interval 180 days")


@query(f"SELECT job_id, CASE WHEN {_OLD_SQL} THEN 'EXPIRED' ELSE status END AS status, epoch_us(CASE WHEN {_OLD_SQL} AND status <> 'EXPIRED' THEN coalesce(closed_at, {_AS_OF}) ELSE closed_at END) AS closed_at_us FROM jobs")
def retention_expire(spark: SparkSession, d: str) -> DataFrame:
    return maintain.expire(table(spark, d, "jobs"), _old(), as_of()).select("job_id", "status", micros("closed_at"))


@query(f"SELECT job_id FROM jobs WHERE NOT coalesce({_OLD_SQL}, false)")
def retention_delete(spark: SparkSession, d: str) -> DataFrame:
    return maintain.keep(table(spark, d, "jobs"), _old()).select("job_id")


@query(f"SELECT count(*) AS total, count(*) FILTER ({_OLD_SQL}) AS out_of_window, count(*) FILTER ({_OLD_SQL} AND NOT posted_at_is_valid) AS out_without_date FROM jobs")
def retention_preview(spark: SparkSession, d: str) -> DataFrame:
    return maintain.preview(table(spark, d, "jobs"), _old(), F.col("posted_at_is_valid"))


_SLUGS = ", ".join(f"('{s}', '{n}')" for s, n in classify.CATEGORIES)


@query(f"""SELECT coalesce(category_slug, '(none)') AS slug, name, count(*) AS n FROM jobs LEFT JOIN (VALUES {_SLUGS}) c(slug, name) ON c.slug = category_slug
    WHERE category_slug IS NULL OR category_slug NOT IN ('data', 'software') GROUP BY ALL""")
def purge_report(spark: SparkSession, d: str) -> DataFrame:
    return maintain.purge_report(table(spark, d, "jobs"), "category_slug", ["data", "software"], classify.categories(spark))


# --- scalar functions

@query("""SELECT record_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key,
    left(sha256(left(trim(regexp_replace(lower(coalesce(description_text, '')), '\\s+', ' ', 'g')), 4000)), 32) AS digest FROM normalized_jobs""".replace("\\\\", "\\"))
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_jobs").select("record_id", text.key(F.col("title")).alias("title_key"), text.digest(F.col("description_text")).alias("digest"))


@query(r"""SELECT id, nullif(trim(regexp_replace(regexp_replace(name, '\b(inc|incorporated|llc|l\.l\.c|ltd|limited|corp|corporation|co|company|gmbh|plc|sa|nv|bv|ag|pty|llp|lp|holdings|group|international|worldwide)\b\.?', ' ', 'g'),
    '[^a-z0-9]+', ' ', 'g')), '') AS company_key, nullif(regexp_extract(lower(website), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]+)', 1), '') AS domain FROM companies""")
def company_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("id", text.company_key(F.col("name")).alias("company_key"), text.domain(F.col("website")).alias("domain"))


_LOWER_WORDS = ", ".join(f"'{w}'" for w in text.CONNECTIVES)


@query(r"""WITH w AS (SELECT list_filter(regexp_split_to_array(trim(industry), '\s+'), lambda x: x <> '') AS ws FROM companies),
    t AS (SELECT list_transform(ws, lambda x, i: CASE WHEN i > 1 AND lower(x) IN (@) THEN lower(x) ELSE array_to_string(list_transform(string_split(x, '/'),
        lambda p: array_to_string(list_transform(string_split(p, '-'), lambda q: upper(left(q, 1)) || lower(substr(q, 2))), '-')), '/') END) AS ws FROM w)
    SELECT nullif(left(array_to_string(ws, ' '), 120), '') AS industry, count(*) AS n FROM t GROUP BY 1""".replace("@", _LOWER_WORDS))
def title_cased(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").groupBy(text.title_case(F.col("industry")).alias("industry")).agg(F.count("*").alias("n"))


@query("SELECT record_id, nullif(split_part(external_id, ':', 1), external_id) AS provider FROM normalized_jobs")
def id_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_jobs").select("record_id", text.prefix(F.col("external_id")).alias("provider"))


@query(r"""SELECT record_id, CASE WHEN coalesce(regexp_replace(lower(raw_employment_type), '[^a-z0-9]', '', 'g'), '') = '' THEN 'UNKNOWN'
    WHEN starts_with(e, 'full') OR starts_with(e, 'permanent') OR starts_with(e, 'regular') THEN 'FULL_TIME' WHEN starts_with(e, 'part') THEN 'PART_TIME' WHEN starts_with(e, 'contract') OR starts_with(e, 'freelance') THEN 'CONTRACT'
    WHEN starts_with(e, 'temp') OR starts_with(e, 'seasonal') THEN 'TEMPORARY' WHEN starts_with(e, 'intern') OR starts_with(e, 'apprenticeship') THEN 'INTERNSHIP' WHEN starts_with(e, 'volunteer') THEN 'VOLUNTEER' ELSE 'OTHER' END AS employment_type,
    CASE lower(trim(raw_salary_interval)) WHEN 'hour' THEN 'HOURLY' WHEN 'hourly' THEN 'HOURLY' WHEN 'day' THEN 'DAILY' WHEN 'daily' THEN 'DAILY' WHEN 'week' THEN 'WEEKLY' WHEN 'weekly' THEN 'WEEKLY' WHEN 'month' THEN 'MONTHLY' WHEN 'monthly' THEN 'MONTHLY'
    WHEN 'year' THEN 'ANNUAL' WHEN 'yearly' THEN 'ANNUAL' WHEN 'annual' THEN 'ANNUAL' WHEN 'annually' THEN 'ANNUAL' ELSE 'UNKNOWN' END AS salary_interval, CASE WHEN regexp_full_match(upper(trim(salary_currency)), '[A-Z]{3}') THEN upper(trim(salary_currency)) END AS currency
    FROM (SELECT *, regexp_replace(lower(raw_employment_type), '[^a-z0-9]', '', 'g') AS e FROM normalized_jobs)""")
def code_maps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_jobs").select(
        "record_id", text.first_prefix(F.col("raw_employment_type"), text.EMPLOYMENT, "OTHER", "UNKNOWN").alias("employment_type"),
        text.lookup(F.col("raw_salary_interval"), text.INTERVALS, "UNKNOWN").alias("salary_interval"), text.currency_code(F.col("salary_currency")).alias("currency"),
    )


_TRACKING = ", ".join(f"'{w}'" for w in urls.TRACKING)


@query(r"""WITH s AS (SELECT record_id, lower(regexp_extract(u, p, 1, 'i')) AS scheme, lower(regexp_extract(u, p, 2, 'i')) AS host, regexp_extract(u, p, 3, 'i') AS path, regexp_extract(u, p, 4, 'i') AS q
        FROM (SELECT record_id, trim(apply_url) AS u, '^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$' AS p FROM normalized_jobs)),
    k AS (SELECT *, list_sort(list_filter(list_transform(string_split(q, '&'), lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': CASE WHEN instr(x, '=') > 0 THEN url_decode(replace(substr(x, instr(x, '=') + 1), '+', ' ')) END}),
        lambda x: coalesce(x.v, '') <> '' AND lower(x.k) NOT IN (@))) AS kv FROM s),
    c AS (SELECT record_id, CASE WHEN scheme <> '' AND host <> '' THEN scheme || '://' || regexp_replace(regexp_replace(regexp_replace(host, '^www\.', ''), ':443$', ''), ':80$', '') || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
        || CASE WHEN len(kv) > 0 THEN '?' || array_to_string(list_transform(kv, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') ELSE '' END END AS url FROM k)
    SELECT record_id, url, sha256(url) AS url_hash FROM c""".replace("@", _TRACKING))
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "normalized_jobs").select("record_id", urls.canonical(F.col("apply_url")).alias("url"))
    return made.withColumn("url_hash", F.sha2(F.col("url").cast("binary"), 256))


_KEY_PARTS = """words AS (
    SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(company_name), '\\bl\\.l\\.c\\b', 'llc', 'g'), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '' AND NOT list_contains([@LEGAL], x)) AS cw,
        list_filter(regexp_split_to_array(regexp_extract(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '^[^|–—-]*'), '[^\\p{L}\\p{N}_]+'),
            lambda x: x <> '' AND NOT list_contains([@LEVEL], x) AND NOT regexp_full_match(x, '[0-9]+')) AS tw
    FROM normalized_jobs),
    keyed AS (
    SELECT *, coalesce(nullif(trim(regexp_replace(array_to_string(cw, ' '), '[^a-z0-9]+', ' ', 'g')), ''), company_name) AS ck,
        coalesce(nullif(trim(regexp_replace(array_to_string(tw, ' '), '[^a-z0-9]+', ' ', 'g')), ''), trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS tk FROM words)""".replace(
    "\\\\", "\\").replace("@LEGAL", ", ".join(f"'{w}'" for w in text.LEGAL_WORDS)).replace("@LEVEL", ", ".join(f"'{w}'" for w in text.LEVEL_WORDS))
_GENERIC = ", ".join(f"'{w}'" for w in dedupe.GENERIC_TITLES)


@query(f"""WITH {_KEY_PARTS} SELECT record_id, title_key, sha256(coalesce(source, '') || '|' || coalesce(external_id, '')) AS l1,
    CASE WHEN company_name <> '' AND tk <> '' AND raw_city IS NOT NULL AND raw_state IS NOT NULL AND tk NOT IN ({_GENERIC}) AND lower(trim(title)) NOT IN ({_GENERIC})
        THEN sha256(coalesce(ck, '') || '|' || tk || '|' || coalesce(raw_country, '') || '|' || raw_state || '|' || lower(raw_city)) END AS l3,
    sha256(coalesce(ck, '') || '|' || coalesce(tk, '') || '|' || coalesce(raw_country, '') || '|' || coalesce(raw_state, '') || '|' || coalesce(lower(raw_city), '') || '|'
        || left(sha256(left(trim(regexp_replace(lower(coalesce(description_text, '')), '\\s+', ' ', 'g')), 4000)), 32)) AS l4 FROM (SELECT *, tk AS title_key FROM keyed)""".replace("\\\\", "\\"))
def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    keyed = dedupe.with_keys(table(spark, d, "normalized_jobs"), "source", "external_id", "apply_url", "company_name", "title", ("raw_country", "raw_state", "raw_city"), "description_text")
    return keyed.select("record_id", "title_key", "l1", "l3", "l4")


@query("""SELECT raw_id, json_extract_string(m, '$.title') AS title, json_extract_string(m, '$.location.city') AS city FROM (
    SELECT raw_id, CASE WHEN json_type(m1) = 'VARCHAR' THEN CASE WHEN json_valid(m1 ->> '$') THEN CAST(m1 ->> '$' AS JSON) END ELSE m1 END AS m FROM (
    SELECT raw_id, CASE WHEN json_type(m0) = 'VARCHAR' THEN CASE WHEN json_valid(m0 ->> '$') THEN CAST(m0 ->> '$' AS JSON) END ELSE m0 END AS m1 FROM (
    SELECT raw_id, CASE WHEN json_valid(payload) THEN json_extract(payload, '$.job_model_json') END AS m0 FROM raw_records)))""")
def json_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = jsonx.with_decoded(table(spark, d, "raw_records").select("raw_id", "payload"), "_top", F.col("payload"))
    rows = jsonx.with_decoded(rows, "_model", jsonx.member(F.col("_top"), "$.job_model_json", "variant"), parsed=True)
    return rows.select("raw_id", jsonx.member(F.col("_model"), "$.title").alias("title"), jsonx.member(F.col("_model"), "$.location.city").alias("city"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) IN (0, 1) THEN TRY_CAST(json_extract_string(props, '$.k') AS INT) = 1 END AS flag FROM events""")
def coercions(spark: SparkSession, d: str) -> DataFrame:
    k = jsonx.member(jsonx.decoded(F.col("props")), "$.k")
    return table(spark, d, "events").select("event_id", jsonx.number(k).alias("k"), jsonx.boolean(k).alias("flag"))


@query(f"""SELECT job_id, posted_at IS NOT NULL AND NOT coalesce(posted_at > {_AS_OF} + INTERVAL 24 HOUR, false) AND NOT coalesce(year(posted_at) < 2000, false) AS valid,
    CASE WHEN status IN ('EXPIRED', 'REMOVED') THEN 'EXPIRED' WHEN first_seen_at > {_AS_OF} - INTERVAL 1 HOUR AND first_seen_at <= {_AS_OF} THEN 'FOUND_LAST_HOUR'
    WHEN first_seen_at > {_AS_OF} - INTERVAL 6 HOUR AND first_seen_at <= {_AS_OF} THEN 'FOUND_LAST_6_HOURS' WHEN CAST(first_seen_at AS DATE) = DATE '2026-06-15' THEN 'FOUND_TODAY'
    WHEN posted_at_is_valid AND posted_at > {_AS_OF} - INTERVAL 24 HOUR AND posted_at <= {_AS_OF} THEN 'POSTED_LAST_24_HOURS' WHEN posted_at_is_valid AND CAST(posted_at AS DATE) = DATE '2026-06-15' THEN 'POSTED_TODAY'
    WHEN CAST(last_updated_at AS DATE) = DATE '2026-06-15' THEN 'UPDATED_TODAY' ELSE 'OLDER' END AS bucket FROM jobs""")
def freshness_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    bucket = freshness.bucket(c("status"), c("first_seen_at"), c("posted_at"), c("posted_at_is_valid"), c("last_updated_at"), as_of())
    return table(spark, d, "jobs").select("job_id", freshness.assess(c("posted_at"), as_of())["valid"].alias("valid"), bucket.alias("bucket"))


_RULES = tuple(classify.Rule(n, w) for n, w in (("manager", ("manager", "supervisor")), ("clinical", ("clinic", "laborator")), ("finance", ("payroll", "account", "insurance"))))


@query(r"""SELECT record_id, coalesce(CASE WHEN regexp_matches(title, '(?i)\b(manager|supervisor)') THEN 'manager' WHEN regexp_matches(title, '(?i)\b(clinic|laborator)') THEN 'clinical' WHEN regexp_matches(title, '(?i)\b(payroll|account|insurance)') THEN 'finance' END,
    CASE WHEN regexp_matches(department, '(?i)\b(manager|supervisor)') THEN 'manager' WHEN regexp_matches(department, '(?i)\b(clinic|laborator)') THEN 'clinical' WHEN regexp_matches(department, '(?i)\b(payroll|account|insurance)') THEN 'finance' END, 'other') AS category FROM normalized_jobs""")
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_jobs").select("record_id", classify.category(F.col("title"), F.col("department"), _RULES).alias("category"))


_STATED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.SOURCE_LEVELS.items())


@query(f"""SELECT record_id, coalesce({classify.sql_chain("title", classify.CATEGORY_RULES)}, {classify.sql_chain("department", classify.CATEGORY_RULES)}, 'other') AS category,
    coalesce(CASE lower(trim(seniority)) {_STATED} END, {classify.sql_chain("title", classify.LEVEL_RULES)}, 'UNKNOWN') AS level FROM normalized_jobs""")
def classify_all(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_jobs")
    return rows.select("record_id", classify.category(F.col("title"), F.col("department")).alias("category"), classify.level(F.col("title"), F.col("seniority")).alias("level"))


_SEARCH = 'payroll "menu planning" -drivers or "night cover" returns'
#: The same query spelled out with the inflections that English has.
_HIT_SQL = r"""((regexp_matches(w, '\bpayrolls?\b') AND regexp_matches(w, '\bmenus?[^\p{L}\p{N}]+plan(s|ned|ning|e|es|ed|ing)?\b') AND NOT regexp_matches(w, '\bdrivers?\b'))
    OR (regexp_matches(w, '\bnights?[^\p{L}\p{N}]+cover(s|ed|ing)?\b') AND regexp_matches(w, '\breturn(s|ed|ing)?\b')))"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "normalized_jobs").select("record_id", search.weighted_document(c("title"), c("department"), c("raw_city"), c("description_text")).alias("doc"))


@query(f"SELECT record_id FROM (SELECT record_id, lower(concat_ws(' ', title, department, raw_city, left(description_text, 100000))) AS w FROM normalized_jobs) WHERE {_HIT_SQL}")
def fulltext_match(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).filter(search.matches(search.whole(F.col("doc")), search.parse(_SEARCH))).select("record_id")


_RANKED = "planned or payroll"


def _score_sql() -> str:
    fields = (("title", 1.0), ("department", 0.4), ("raw_city", 0.2), ("left(description_text, 100000)", 0.1))
    words = r"\b(plan|plans|planned|planning|planed|planing)\b", r"\b(payroll|payrolls|payrolled|payrolling)\b"
    doc = lambda f: f"(' ' || regexp_replace(lower(coalesce({f}, '')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ')".replace("\\\\", "\\")
    return " + ".join(f"{w} * len(regexp_extract_all({doc(f)}, '{p}')) / (1 + ln(1 + length({doc(f)})))" for f, w in fields for p in words)


@query(f"SELECT record_id, round(rank, 6) AS rank FROM (SELECT record_id, {_score_sql()} AS rank FROM normalized_jobs) WHERE rank > 0 ORDER BY round(rank, 6) DESC, record_id DESC LIMIT 50")
def fulltext_rank(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best by rank (a top-k report)."""
    q = search.parse(_RANKED)
    hits = _documents(spark, d).filter(search.matches(search.whole(F.col("doc")), q))
    score = F.round(search.rank([F.col("doc")[n] for n in "abcd"], q), 6)
    return hits.select("record_id", score.alias("rank")).orderBy(F.desc("rank"), F.desc("record_id")).limit(50)


@query()
def location_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_jobs").select("record_id", "company_external_id", *location.FIELDS)
    rows = listing.with_registry(rows, table(spark, d, "companies").select("id", "country"), "company_external_id")
    return location.resolve(rows, company_country="company_country", cities=location.city_facts(table(spark, d, "places"))).select("record_id", "where.*")


@query("""SELECT record_id, CASE WHEN lower(trim(raw_workplace_type)) IN ('remote', 'fully remote') THEN 'REMOTE' WHEN lower(trim(raw_workplace_type)) = 'hybrid' THEN 'HYBRID'
    WHEN lower(trim(raw_workplace_type)) IN ('onsite', 'on-site', 'on site', 'in office', 'in-office') THEN 'ONSITE' WHEN coalesce(source_is_remote, false) THEN 'REMOTE'
    WHEN regexp_matches(raw_location_text, '(?i)\\b(hybrid|flex(ible)?\\s*(work|location))\\b') THEN 'HYBRID' WHEN regexp_matches(raw_location_text, '(?i)\\b(remote|work\\s*from\\s*home|wfh|telecommute|anywhere|distributed|virtual)\\b') THEN 'REMOTE'
    WHEN regexp_matches(raw_location_text, '(?i)\\b(on[\\s-]?site|in[\\s-]?office|in[\\s-]?person)\\b') THEN 'ONSITE' ELSE 'UNKNOWN' END AS remote_type FROM normalized_jobs""")
def remote_types(spark: SparkSession, d: str) -> DataFrame:
    kind = location.remote_type(F.col("raw_workplace_type"), F.col("source_is_remote"), F.col("raw_location_text"))
    return table(spark, d, "normalized_jobs").select("record_id", kind.alias("remote_type"))


# --- extras: event time

@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.tumbling(rows, "ts", "1 hour", "event_type", "value").select(micros("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT epoch_us(b) AS window_start_us, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY b")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sliding(rows, "ts", "1 hour", "30 minutes").select(micros("window_start"), "n")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, epoch_us(min(ts)) AS session_start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(rows, "ts", "30 minutes", "user_id").select("user_id", micros("session_start"), "n")
