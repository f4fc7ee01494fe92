"""Queries of loading and serving on the domain's tables, each with its SQL; they register with those of ``reference``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import display, jsonx, search, text
from millrace.operators import feed, ingest, maintain, quality, upsert
from millrace.plans.reference import _AS_OF, as_of, query
from millrace.session import table
from millrace.sources import listing

#: Delta files from this day on are the second of two loads.
LATER = "2026-01-01"
FIRST, SECOND = (datetime(2026, 1, d, tzinfo=timezone.utc) for d in (1, 2))
_MATCHERS = (("url", "L2_APPLY_URL"), ("print", "L4_CONTENT_FINGERPRINT"))
_COLUMNS = ("title", "url", "print", "content", "status")

_LOAD_SQL = f"""r AS (
    SELECT record_id, source, external_id, title, apply_url AS url, lower(title) || '|' || lower(raw_city) AS print,
        sha256(title || '|' || coalesce(description_text, '') || '|' || coalesce(lower(raw_status), '')) AS content, CASE WHEN lower(raw_status) = 'closed' THEN 'EXPIRED' ELSE 'ACTIVE' END AS status,
        coalesce(regexp_extract(source_path, '([0-9]+-[0-9]+-[0-9]+)', 1) >= '{LATER}', false) AS late FROM normalized_jobs WHERE external_id IS NOT NULL),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY late, source, external_id ORDER BY record_id) AS k FROM r) WHERE k = 1),
    a AS (SELECT *, row_number() OVER (ORDER BY source, external_id) AS id FROM w WHERE NOT late),
    u AS (SELECT url, min(id) AS id FROM a WHERE url IS NOT NULL GROUP BY url),
    p AS (SELECT print, min(id) AS id FROM a WHERE print IS NOT NULL GROUP BY print),
    b AS (SELECT w.*, coalesce(k.id, u.id, p.id) AS target, k.status AS was,
            CASE WHEN k.id IS NOT NULL THEN CASE WHEN k.content = w.content THEN 'unchanged' ELSE 'updated' END WHEN coalesce(u.id, p.id) IS NOT NULL THEN 'merged' ELSE 'inserted' END AS action,
            CASE WHEN k.id IS NULL THEN CASE WHEN u.id IS NOT NULL THEN 'L2_APPLY_URL' WHEN p.id IS NOT NULL THEN 'L4_CONTENT_FINGERPRINT' END END AS matched_by
        FROM w LEFT JOIN a k ON k.source = w.source AND k.external_id = w.external_id LEFT JOIN u ON u.url = w.url LEFT JOIN p ON p.print = w.print WHERE w.late),
    n AS (SELECT *, CASE WHEN action = 'inserted' THEN (SELECT count(*) FROM a) + row_number() OVER (PARTITION BY action ORDER BY source, external_id) ELSE target END AS id FROM b)"""


def _second_load(spark: SparkSession, d: str) -> upsert.Loaded:
    """All of normalized_jobs in two loads, the first file days before the later ones; the first row of a key in a load holds."""
    c = F.col
    rows = table(spark, d, "normalized_jobs").filter("external_id is not null").select(
        "record_id", "source", "external_id", "title", c("apply_url").alias("url"), F.concat(F.lower("title"), F.lit("|"), F.lower("raw_city")).alias("print"),
        F.sha2(F.concat("title", F.lit("|"), F.coalesce("description_text", F.lit("")), F.lit("|"), F.coalesce(F.lower("raw_status"), F.lit(""))).cast("binary"), 256).alias("content"),
        F.when(F.lower("raw_status") == "closed", "EXPIRED").otherwise("ACTIVE").alias("status"), F.coalesce(F.regexp_extract("source_path", "([0-9]+-[0-9]+-[0-9]+)", 1) >= LATER, F.lit(False)).alias("late"),
    )
    rows = session.cut(upsert.first_wins(rows, ["late", "source", "external_id"], ["record_id"]))
    at = lambda t: F.lit(t).cast("timestamp")
    one = upsert.load(None, None, rows.filter("not late").drop("late"), _COLUMNS, "content", _MATCHERS, seen_at=at(FIRST), order=["record_id"])
    return upsert.load(session.cut(one.state), session.cut(one.provenance), rows.filter("late").drop("late"), _COLUMNS, "content", _MATCHERS, seen_at=at(SECOND), order=["record_id"])


@query(f"WITH {_LOAD_SQL} SELECT source, external_id, action, id, matched_by FROM n")
def load_actions(spark: SparkSession, d: str) -> DataFrame:
    return _second_load(spark, d).rows.select("source", "external_id", "action", "id", "matched_by")


@query(f"""WITH {_LOAD_SQL} SELECT a.id, coalesce(n.title, a.title) AS title, coalesce(n.status, a.status) AS status, 1 AS first_seen, CASE WHEN s.id IS NULL THEN 1 ELSE 2 END AS last_seen, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS last_updated
    FROM a LEFT JOIN n ON n.id = a.id AND n.action = 'updated' LEFT JOIN n s ON s.id = a.id AND s.action IN ('updated', 'unchanged')
    UNION ALL SELECT id, title, status, 2, 2, 2 FROM n WHERE action = 'inserted'""")
def load_state(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.dayofmonth(c)
    state = _second_load(spark, d).state
    return state.select("id", "title", "status", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), day("last_updated_at").alias("last_updated"))


@query(f"""WITH {_LOAD_SQL} SELECT a.id, a.source, a.external_id, true AS is_primary, 'L1_SOURCE_ID' AS matched_by, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS last_seen FROM a LEFT JOIN n ON n.source = a.source AND n.external_id = a.external_id
    UNION ALL SELECT id, source, external_id, action = 'inserted', coalesce(matched_by, 'L1_SOURCE_ID'), 2 FROM n WHERE action IN ('inserted', 'merged')""")
def load_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = _second_load(spark, d).provenance
    return rows.select("id", "source", "external_id", "is_primary", "matched_by", F.dayofmonth("last_seen_at").alias("last_seen"))


@query(f"""WITH {_LOAD_SQL} SELECT id, CASE action WHEN 'inserted' THEN 'CREATED' WHEN 'merged' THEN 'MERGED' ELSE CASE WHEN status = 'EXPIRED' AND was <> 'EXPIRED' THEN 'EXPIRED' WHEN was = 'EXPIRED' AND status = 'ACTIVE' THEN 'REACTIVATED' ELSE 'UPDATED' END END AS event,
    CASE WHEN action = 'updated' THEN was END AS previous_status, CASE WHEN action <> 'merged' THEN status END AS new_status FROM n WHERE action <> 'unchanged'""")
def load_events(spark: SparkSession, d: str) -> DataFrame:
    return _second_load(spark, d).events.select("id", "event", "previous_status", "new_status")


@query()
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the whole chain does with all records, loaded twice; the second time inserts nothing."""
    rows, companies, places = (table(spark, d, t) for t in ("normalized_jobs", "companies", "places"))
    from millrace.functions import location

    settings = ingest.Settings(countries=("US", "IN", "CA", "GB", "DE", "AU"))
    accepted, refused = ingest.prepare(rows, companies, as_of(), settings, location.city_facts(places))
    accepted, tables, out = session.cut(accepted), {}, None
    for run in (1, 2):
        after, made = ingest.load(tables, accepted, as_of())
        one = ingest.counters(accepted, refused, made.rows).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
        tables = {n: session.cut(after[n]) for n in ("jobs", "job_sources")} if run == 1 else tables
    return out


@query(r"""WITH parsed AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM raw_records),
    m1 AS (SELECT raw_id, CASE WHEN json_type(p) = 'OBJECT' THEN p END AS p, json_extract(p, '$.job_model_json') AS m FROM parsed),
    m2 AS (SELECT raw_id, p, CASE WHEN json_type(m) = 'VARCHAR' THEN CASE WHEN json_valid(m ->> '$') THEN CAST(m ->> '$' AS JSON) END ELSE m END AS m FROM m1),
    m3 AS (SELECT raw_id, p, CASE WHEN json_type(m) = 'VARCHAR' THEN CASE WHEN json_valid(m ->> '$') THEN CAST(m ->> '$' AS JSON) END ELSE m END AS m FROM m2)
    SELECT raw_id, nullif(trim(p ->> '$.id'), '') AS external_id, nullif(trim(m ->> '$.title'), '') AS title, nullif(trim(m ->> '$.location.city'), '') AS raw_city,
        CASE WHEN lower(trim(m ->> '$.location.workplace_type')) NOT IN ('tbc', '') THEN trim(m ->> '$.location.workplace_type') END AS raw_workplace_type, nullif(trim(p ->> '$.status'), '') AS raw_status,
        CASE WHEN instr(trim(p ->> '$.id'), ':') > 1 THEN split_part(trim(p ->> '$.id'), ':', 1) END AS ats_provider FROM m3""")
def normalize_records(spark: SparkSession, d: str) -> DataFrame:
    rows = listing.normalized(table(spark, d, "raw_records").select("raw_id", "payload"), "delta")
    return rows.select("raw_id", "external_id", "title", "raw_city", "raw_workplace_type", "raw_status", "ats_provider")


@query("""SELECT record_id, CASE WHEN lower(raw_status) = 'closed' THEN 'EXPIRED' ELSE 'ACTIVE' END AS status,
    epoch_us(CASE WHEN lower(raw_status) = 'closed' THEN coalesce(closed_at, close_at, source_fetched_at) ELSE closed_at END) AS closed_at_us FROM normalized_jobs""")
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    life = ingest.lifecycle(c("raw_status"), c("closed_at"), c("close_at"), c("source_fetched_at"))
    return table(spark, d, "normalized_jobs").select("record_id", life.alias("l")).select("record_id", "l.status", F.unix_micros("l.closed_at").alias("closed_at_us"))


@query("""WITH c AS (SELECT id, name, industry, regexp_extract(lower(website), '^(?:https?://)?(?:www\\.)?([^/?#:]+)', 1) AS domain FROM companies WHERE website IS NOT NULL),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM c WHERE domain LIKE '%.%') WHERE n = 1),
    i AS (SELECT record_id, company_name AS name, department AS industry, regexp_extract(lower(trim(apply_url)), '^(?:https?://)(?:www\\.)?([^/?#:@]+)', 1) AS host FROM normalized_jobs),
    x AS (SELECT record_id, name, industry, CASE WHEN host LIKE '%.%' THEN host END AS domain FROM i),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY record_id DESC) AS n FROM x WHERE domain IS NOT NULL) WHERE n = 1),
    a AS (SELECT domain, name, industry FROM l WHERE domain NOT IN (SELECT domain FROM k) UNION ALL SELECT domain, name, industry FROM x WHERE domain IS NULL)
    SELECT k.id, k.domain, CASE WHEN l.domain IS NOT NULL THEN l.name ELSE k.name END AS name, coalesce(l.industry, k.industry) AS industry FROM k LEFT JOIN l ON l.domain = k.domain
    UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY domain NULLS FIRST, name NULLS FIRST, industry NULLS FIRST), domain, name, industry FROM a""".replace("\\\\", "\\"))
def dimension_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Companies by the domain of their website, after an upsert of those that postings name by the host of their link."""
    known = table(spark, d, "companies").select("id", text.domain(F.col("website")).alias("domain"), "name", "industry").filter("domain is not null")
    news = table(spark, d, "normalized_jobs").select("record_id", text.domain(F.when(F.col("apply_url").rlike(r"(?i)^\s*https?://[^/?#@]*(?:[/?#]|$)"), F.col("apply_url"))).alias("domain"), F.col("company_name").alias("name"), F.col("department").alias("industry"))
    return upsert.upsert_dimension(session.cut(upsert.first_wins(known, ["domain"], ["id"])), news, "domain", ["name", "industry"], replace=["name"], order=["record_id"])


@query("""SELECT state_code, city, source_row_id FROM (SELECT *, row_number() OVER (PARTITION BY state_code, city ORDER BY source_row_id) AS n FROM job_sources) j
    WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM places p WHERE coalesce(p.state_code, '') = coalesce(j.state_code, '') AND coalesce(p.city, '') = coalesce(j.city, ''))""")
def missing_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places of sources that the list lacks, each by the first row that has it."""
    key = ["state_code", "city"]
    return upsert.missing_rows(table(spark, d, "places").select(*key), table(spark, d, "job_sources").select(*key, "source_row_id"), key, ["source_row_id"])


@query("SELECT company_external_id, first(record_id ORDER BY record_id) AS first_id, last(record_id ORDER BY record_id) AS last_id, last(company_name ORDER BY record_id) AS last_name FROM normalized_jobs GROUP BY 1")
def first_and_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_jobs").select("company_external_id", "record_id", "company_name")
    first = upsert.first_wins(rows, ["company_external_id"], ["record_id"]).select(F.col("company_external_id").alias("_c"), F.col("record_id").alias("first_id"))
    last = upsert.last_wins(rows, ["company_external_id"], ["record_id"]).select("company_external_id", F.col("record_id").alias("last_id"), F.col("company_name").alias("last_name"))
    return last.join(first, F.col("company_external_id").eqNullSafe(F.col("_c"))).drop("_c")


@query("""SELECT job_id, CASE WHEN category_slug IN ('data', 'other') THEN CASE WHEN regexp_matches(title, '(?i)\\b(analyst|insight)') THEN 'data-analytics' WHEN regexp_matches(title, '(?i)\\bscien') THEN 'data-science' ELSE 'data-engineering' END ELSE category_slug END AS category_slug FROM jobs""".replace("\\\\", "\\"))
def coarse_remap(spark: SparkSession, d: str) -> DataFrame:
    rules = (("data-analytics", r"\b(analyst|insight)"), ("data-science", r"\bscien"))
    return maintain.remap(table(spark, d, "jobs"), "category_slug", ["data", "other"], F.col("title"), rules, "data-engineering").select("job_id", "category_slug")


@query("""WITH l AS (SELECT source, reason, count(*) AS n FROM (SELECT source, unnest([x FOR x IN [CASE WHEN trim(coalesce(title, '')) = '' THEN 'MISSING_TITLE' END, CASE WHEN trim(coalesce(apply_url, '')) = '' THEN 'MISSING_APPLY_URL' END,
    CASE WHEN trim(coalesce(company_external_id, '')) = '' THEN 'MISSING_COMPANY' END] IF x IS NOT NULL]) AS reason FROM normalized_jobs) GROUP BY 1, 2) SELECT source, reason, n FROM l ORDER BY n DESC, source, reason LIMIT 20""")
def ledger_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Reasons by source over ledgers that keep few examples."""
    c = F.col
    made = quality.reasons((text.clean(c("title")).isNull(), "MISSING_TITLE"), (text.clean(c("apply_url")).isNull(), "MISSING_APPLY_URL"), (text.clean(c("company_external_id")).isNull(), "MISSING_COMPANY"))
    _, refused = quality.split(table(spark, d, "normalized_jobs").withColumn("reasons", made))
    ledgers = refused.groupBy("source", "reason").agg(F.count("*").alias("n")).select("source", "reason", F.least("n", F.lit(5)).alias("kept"), F.greatest(c("n") - 5, F.lit(0)).alias("overflow"))
    return quality.breakdown(ledgers, ("source", "reason"))


# --- labels

@query(r"""WITH b AS (SELECT job_id, salary_interval AS i, CASE WHEN salary_currency IS NULL OR salary_currency = 'USD' THEN '$' ELSE salary_currency || ' ' END AS sign, CASE WHEN salary_min > 0 THEN CAST(salary_min AS DOUBLE) END AS a, CASE WHEN salary_max > 0 THEN CAST(salary_max AS DOUBLE) END AS z,
        CASE salary_interval WHEN 'HOURLY' THEN '/hr' WHEN 'DAILY' THEN '/day' WHEN 'WEEKLY' THEN '/wk' WHEN 'MONTHLY' THEN '/mo' ELSE '' END AS per FROM jobs),
    t AS (SELECT *, CASE WHEN i = 'ANNUAL' THEN CASE WHEN a >= 1000000 THEN CASE WHEN a % 1000000 = 0 THEN CAST(CAST(a / 1000000 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', a / 1000000) END || 'M' WHEN a >= 1000 THEN CAST(CAST(round(a / 1000) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST(round(a) AS BIGINT) AS VARCHAR) END ELSE CASE WHEN a % 1 = 0 THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE printf('%.2f', a) END END AS ta,
        CASE WHEN i = 'ANNUAL' THEN CASE WHEN z >= 1000000 THEN CASE WHEN z % 1000000 = 0 THEN CAST(CAST(z / 1000000 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', z / 1000000) END || 'M' WHEN z >= 1000 THEN CAST(CAST(round(z / 1000) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST(round(z) AS BIGINT) AS VARCHAR) END ELSE CASE WHEN z % 1 = 0 THEN CAST(CAST(z AS BIGINT) AS VARCHAR) ELSE printf('%.2f', z) END END AS tz FROM b)
    SELECT job_id, CASE WHEN a IS NULL AND z IS NULL THEN NULL WHEN a IS NULL THEN 'Up to ' || sign || tz || per WHEN z IS NULL THEN 'From ' || sign || ta || per WHEN a = z THEN sign || ta || per ELSE sign || ta || '–' || sign || tz || per END AS pay FROM t""")
def pay_labels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "jobs").select("job_id", display.pay_label(c("salary_min"), c("salary_max"), c("salary_currency"), c("salary_interval")).alias("pay"))


@query(f"""SELECT job_id, CASE WHEN remote_type = 'REMOTE' AND coalesce(city, '') = '' THEN CASE WHEN country_code IS NULL THEN 'Remote' ELSE 'Remote (' || country_code || ')' END
        WHEN city IS NULL AND state_code IS NULL THEN CASE country_code WHEN 'US' THEN 'United States' WHEN 'IN' THEN 'India' ELSE 'Location unknown' END ELSE concat_ws(', ', city, state_code) END AS place,
    CASE WHEN posted_at IS NULL THEN 'Posting date not provided by source' WHEN NOT posted_at_is_valid THEN 'Posting date reported by source is unreliable' WHEN s < 0 THEN 'Posted in the future' WHEN s < 60 THEN 'Posted ' || floor(s)::BIGINT || 's ago'
        WHEN s < 3600 THEN 'Posted ' || floor(s / 60)::BIGINT || 'min ago' WHEN s < 86400 THEN 'Posted ' || floor(s / 3600)::BIGINT || 'h ago' WHEN s < 2592000 THEN 'Posted ' || floor(s / 86400)::BIGINT || 'd ago'
        WHEN s < 31536000 THEN 'Posted ' || floor(s / 2592000)::BIGINT || 'mo ago' ELSE 'Posted ' || floor(s / 31536000)::BIGINT || 'yr ago' END AS posted, posted_at IS NOT NULL AND posted_at_is_valid AS trusted
    FROM (SELECT *, (epoch_us({_AS_OF}) - epoch_us(posted_at)) / 1000000.0 AS s FROM jobs)""")
def place_and_date_labels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    posted = display.posted_label(c("posted_at"), c("posted_at_is_valid"), as_of())
    place = display.place_label(c("city"), c("state_code"), c("country_code"), c("remote_type"))
    return table(spark, d, "jobs").select("job_id", place.alias("place"), posted.alias("p")).select("job_id", "place", F.col("p.text").alias("posted"), F.col("p.trusted").alias("trusted"))


# --- entry points

@query("""SELECT j.job_id, j.title, c.name AS company_name, round(r, 6) AS rank FROM (SELECT *, 1.0 * len(regexp_extract_all(lower(title), '\\b(analysts?|analysted|analysting)\\b'))
        / (1 + ln(1 + length(' ' || regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '  ', 'g') || ' '))) AS r FROM jobs WHERE status = 'ACTIVE') j LEFT JOIN companies c ON c.id = j.company_id
    WHERE r > 0 ORDER BY round(r, 6) DESC, j.job_id DESC LIMIT 21""".replace("\\\\", "\\"))
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the most relevant listings (a top-k report)."""
    none = F.lit(None).cast("string")
    jobs = table(spark, d, "jobs").withColumn("search_doc", search.weighted_document(F.col("title"), none, none, none))
    found = feed.search(jobs, table(spark, d, "companies"), feed.Filters(equal={"status": "ACTIVE"}), "analyst", sort="relevance")
    return found.select("job_id", "title", "company_name", "rank")


@query("SELECT j.job_id, j.title, c.name AS company_name, c.website AS company_website, (SELECT count(*) FROM job_sources s WHERE s.job_id = 500) AS n_sources FROM jobs j LEFT JOIN companies c ON c.id = j.company_id WHERE j.job_id = 500")
def job_detail(spark: SparkSession, d: str) -> DataFrame:
    found = feed.detail(table(spark, d, "jobs"), table(spark, d, "companies"), table(spark, d, "job_sources"), 500)
    return found.select("job_id", "title", "company_name", "company_website", "n_sources")


@query(f"""WITH gone AS (SELECT job_id FROM jobs WHERE coalesce(CASE WHEN posted_at_is_valid THEN posted_at END, first_seen_at) < {_AS_OF} - INTERVAL 180 DAY)
    SELECT 'jobs' AS "table", count(*) AS n FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone)
    UNION ALL SELECT 'job_sources', count(*) FROM job_sources WHERE job_id IN (SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone))""")
def retention_job(spark: SparkSession, d: str) -> DataFrame:
    """What is left of jobs and their sources after a retention that deletes."""
    left = maintain.retention({n: table(spark, d, n) for n in ("jobs", "job_sources")}, as_of(), 180, delete=True)
    return left["jobs"].agg(F.lit("jobs").alias("table"), F.count("*").alias("n")).union(left["job_sources"].agg(F.lit("job_sources"), F.count("*")))




# --- runs and small functions

_RUNS_SQL = "(SELECT source, record_id, posted_at AS started_at, source_fetched_at AS finished_at, CASE WHEN raw_status = 'active' THEN 'SUCCEEDED' WHEN raw_status = 'closed' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM normalized_jobs)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Records as runs: they began when they were posted and ended when they were fetched."""
    c = F.col
    status = F.when(c("raw_status") == "active", "SUCCEEDED").when(c("raw_status") == "closed", "FAILED").otherwise("RUNNING")
    return table(spark, d, "normalized_jobs").select("source", "record_id", c("posted_at").alias("started_at"), c("source_fetched_at").alias("finished_at"), status.alias("status"))


@query(f"""SELECT epoch_us(last) AS last_success_us, datediff('second', last, {_AS_OF}) // 3600 AS hours, CASE WHEN last IS NULL THEN 'NEVER' WHEN datediff('second', last, {_AS_OF}) // 3600 > 26 THEN 'STALE' ELSE 'FRESH' END AS state
    FROM (SELECT max(finished_at) FILTER (status = 'SUCCEEDED' AND finished_at <= {_AS_OF}) AS last FROM {_RUNS_SQL})""")
def run_staleness(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).filter(~F.coalesce(F.col("finished_at") > as_of(), F.lit(False)))
    return maintain.staleness(runs, as_of()).select(F.unix_micros("last_success").alias("last_success_us"), "hours", "state")


@query(f"""SELECT record_id, CASE WHEN stale THEN 'FAILED' ELSE status END AS status, epoch_us(CASE WHEN stale THEN {_AS_OF} ELSE finished_at END) AS finished_us
    FROM (SELECT *, coalesce(status = 'RUNNING' AND started_at < {_AS_OF} - INTERVAL 30 MINUTE, false) AS stale FROM {_RUNS_SQL})""")
def runs_reclaimed(spark: SparkSession, d: str) -> DataFrame:
    return maintain.reclaim(_runs(spark, d), as_of()).select("record_id", "status", F.unix_micros("finished_at").alias("finished_us"))


@query(f"""SELECT source, arg_max(record_id, (started_at, record_id)) AS record_id FROM {_RUNS_SQL} WHERE started_at IS NOT NULL GROUP BY source""")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return feed.latest(_runs(spark, d).filter("started_at is not null"), ["source"], [F.desc("started_at"), F.desc("record_id")]).select("source", "record_id")


@query(r"""WITH a AS (SELECT record_id, CASE WHEN regexp_full_match(replace(trim(salary_min), ',', ''), '[0-9]+(\.[0-9]+)?') THEN TRY_CAST(replace(trim(salary_min), ',', '') AS DOUBLE) END AS lo, CASE WHEN regexp_full_match(replace(trim(salary_max), ',', ''), '[0-9]+(\.[0-9]+)?') THEN TRY_CAST(replace(trim(salary_max), ',', '') AS DOUBLE) END AS hi FROM normalized_jobs),
    b AS (SELECT record_id, CASE WHEN lo BETWEEN 0 AND 100000000 THEN lo END AS lo, CASE WHEN hi BETWEEN 0 AND 100000000 THEN hi END AS hi FROM a)
    SELECT record_id, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN least(lo, hi) ELSE lo END, 2) AS low, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN greatest(lo, hi) ELSE hi END, 2) AS high FROM b""")
def amounts_in_order(spark: SparkSession, d: str) -> DataFrame:
    pay = text.amounts_in_order(text.amount(F.col("salary_min")), text.amount(F.col("salary_max")))
    return table(spark, d, "normalized_jobs").select("record_id", pay.alias("p")).select("record_id", F.col("p.low").cast("double").alias("low"), F.col("p.high").cast("double").alias("high"))


@query("""SELECT obs_id, epoch_us(CASE WHEN regexp_matches(posted_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?Z$') THEN TRY_CAST(posted_at AS TIMESTAMPTZ) END) AS at_us FROM job_observations""".replace("\\\\", "\\"))
def iso_instants(spark: SparkSession, d: str) -> DataFrame:
    """Times with a Z, as the plain coercion reads them; other notations are those of ``operators.instants``."""
    at = F.col("posted_at")
    plain = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), jsonx.instant(at))
    return table(spark, d, "job_observations").select("obs_id", F.unix_micros(plain).alias("at_us"))
