from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import display
from millrace.operators import feed, ingest, maintain, quality, upsert
from millrace.sources import listing

NOW = datetime(2026, 6, 15, 12, tzinfo=timezone.utc)
KINDS = {"source_is_remote": "boolean", **dict.fromkeys(("posted_at", "source_fetched_at", "close_at", "closed_at"), "timestamp")}
SCHEMA = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in listing.NORMALIZED) + ", record_id long"
COMPANIES = "id long, name string, website string, industry string, size string, country string, linkedin_url string"


def listing_of(n, external="a:1", title="Welder", **more):
    row = dict.fromkeys(listing.NORMALIZED) | {
        "source": "board", "external_id": external, "title": title, "company_name": "Acme Inc", "company_external_id": "7", "raw_country": "US", "raw_state": "OH", "raw_city": "Yell",
        "description_text": "weld things", "apply_url": f"https://acme.example/{n}", "raw_status": "active", "posted_at": datetime(2026, 6, 1), "salary_min": "90,000", "salary_max": "60000",
        "salary_currency": "usd", "raw_salary_interval": "Year", "raw_employment_type": "Full time",
    }
    row |= more
    return tuple(row[c] for c in listing.NORMALIZED) + (n,)


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as status", "3 as reasons"), spark.createDataFrame([(7, "acme", None, "oil and gas", None, "US", None)], COMPANIES)


def test_rows_are_refused_with_reasons(spark):
    rows = [
        listing_of(1), listing_of(2), listing_of(3, "a:3", title=" "), listing_of(4, "", title=None), listing_of(5, "a:5", raw_country="FR", raw_state=None), listing_of(6, "a:6", raw_country=None, raw_state=None),
        listing_of(7, "a:7", posted_at=datetime(2020, 1, 1)), listing_of(8, "a:8", title="Nurse"), listing_of(9, "a:9", posted_at=datetime(2026, 9, 1)), listing_of(10, "a:10", apply_url="mailto:x"),
        listing_of(11, "a:11", title=None, company_external_id=None), listing_of(12, "a:12", raw_status="CLOSED", source_fetched_at=datetime(2026, 6, 9)),
    ]
    df, companies = frames(spark, rows)
    settings = ingest.Settings.parse("us, ca", blocked="Healthcare,", max_age_days=60)
    assert settings.countries == ("US", "CA") and settings.blocked == ("healthcare",)
    accepted, refused = ingest.prepare(df, companies, F.lit(NOW).cast("timestamp"), settings)
    got = {(r["external_id"], r["reason"], r["refused"]) for r in refused.collect()}
    assert got == {
        ("a:1", "DUPLICATE_IN_BATCH", True), ("a:3", "MISSING_TITLE", True), ("", "MISSING_EXTERNAL_ID", True), ("", "MISSING_TITLE", True), ("a:5", "COUNTRY_NOT_ALLOWED", True), ("a:6", "INVALID_COUNTRY", True),
        ("a:7", "TOO_OLD", True), ("a:8", "CATEGORY_NOT_ALLOWED", True), ("a:9", "FUTURE_POSTED_AT", False), ("a:10", "INVALID_URL", True), ("a:11", "MISSING_TITLE", True), ("a:11", "MISSING_COMPANY", True),
    }
    kept = {r["external_id"]: r for r in accepted.collect()}
    one = kept["a:1"]
    assert set(kept) == {"a:1", "a:9", "a:12"} and one["record_id"] == 1 and one["industry"] == "Oil and Gas" and one["employment_type"] == "FULL_TIME"
    assert (one["salary_min"], one["salary_max"], one["salary_currency"], one["salary_interval"]) == (Decimal("60000.00"), Decimal("90000.00"), "USD", "ANNUAL")
    assert not kept["a:9"]["posted_at_is_valid"] and (kept["a:12"]["status"], kept["a:12"]["closed_at"]) == ("EXPIRED", datetime(2026, 6, 9))
    assert ingest.prepare(df.limit(0), companies, F.lit(NOW).cast("timestamp"))[0].count() == 0


def test_runs_insert_once_then_touch_update_merge_and_close(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "store"))
    first, companies = frames(spark, [listing_of(i, f"a:{i}", title=f"Welder of {i} parts", raw_city=f"Town {i}") for i in range(5)])
    go = lambda rows, day: ingest.run(store, rows, companies, NOW.replace(day=day))
    assert go(first, 16) == {"accepted": 5, "refused": 0, "inserted": 5, "merged": 0, "updated": 0, "unchanged": 0}
    again = go(first, 17)
    assert again["inserted"] == 0 and again["unchanged"] == 5
    later, _ = frames(spark, [
        listing_of(0, "a:0", title="Welder of 0 parts", raw_city="Town 0", raw_status="closed", source_fetched_at=datetime(2026, 6, 18)), listing_of(1, "a:1", title="Chief welder", raw_city="Town 1"),
        listing_of(2, "b:2", title="Other words", raw_city="Town 9"), listing_of(8, "b:8", title="Welder of 3 parts", raw_city="Town 3"), listing_of(9, "c:9", title="New", raw_city="Town 7", raw_country=None, raw_state=None),
        listing_of(10, "c:10", title="New", raw_city="Town 8"),
    ])
    assert go(later, 18) == {"accepted": 5, "refused": 1, "inserted": 1, "merged": 2, "updated": 2, "unchanged": 0}
    jobs = {r["id"]: r for r in store.table("jobs").collect()}
    assert sorted(jobs) == [1, 2, 3, 4, 5, 6] and jobs[1]["status"] == "EXPIRED" and jobs[2]["title"] == "Chief welder" and jobs[6]["title"] == "New"
    assert (jobs[1]["first_seen_at"].day, jobs[1]["last_seen_at"].day, jobs[3]["last_seen_at"].day, jobs[3]["last_updated_at"].day) == (16, 18, 17, 16)
    sources = {r["external_id"]: r for r in store.table("job_sources").collect()}
    assert (sources["b:2"]["id"], sources["b:2"]["matched_by"], sources["b:2"]["is_primary"]) == (3, "L2_APPLY_URL", False)
    assert (sources["b:8"]["id"], sources["b:8"]["matched_by"]) == (4, "L4_CONTENT_FINGERPRINT") and sources["a:0"]["last_seen_at"].day == 18 and sources["c:10"]["is_primary"]
    events = [(r["id"], r["event"]) for r in store.table("job_events").filter("day(occurred_at) = 18").collect()]
    assert sorted(events) == [(1, "EXPIRED"), (2, "UPDATED"), (3, "MERGED"), (4, "MERGED"), (6, "CREATED")]
    assert store.table("companies").count() == 1 and store.table("locations").count() == 7 and store.table("runs").count() == 3
    assert {(r["reason"], r["n"]) for r in quality.breakdown(store.table("rejections")).collect()} == {("INVALID_COUNTRY", 1)}
    assert [p for p in store.spark.read.parquet(store.tables()["job_events"]).inputFiles() if "month=2026-06" in p]
    hits = feed.search(store.table("jobs").withColumnRenamed("id", "job_id").withColumn("company_id", F.lit(7)).withColumn("source", F.lit("x")), companies, feed.Filters(), "chief", sort="relevance").collect()
    assert [r["job_id"] for r in hits] == [2] and hits[0]["company_name"] == "acme"


def test_one_writer_at_a_time(spark, tmp_path):
    a, b = (upsert.Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.begin()
    with pytest.raises(RuntimeError, match="active"):
        b.begin()
    assert not b.reclaim(30) and b.reclaim(0)
    b.begin()
    b.end()
    one = spark.range(1)
    assert a.commit({"t": one}) == 1
    b.versions = lambda: []  # a writer that has not seen the first version
    with pytest.raises(RuntimeError, match="another writer"):
        b.commit({"t": one})
    assert a.table("t").count() == 1


def test_ids_are_dense_in_order(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 501).alias("k")).repartition(7)
    got = sorted((r["k"], r["id"]) for r in upsert.new_ids(rows, ["k"], 10).collect())
    assert [i for _, i in got] == list(range(11, 511)) and got == sorted(got)
    assert upsert.new_ids(rows.limit(0), ["k"], 10).count() == 0


def test_several_updates_of_one_row_keep_the_last(spark):
    state = spark.createDataFrame([(1, "old", "x")], "id long, v string, keep string").withColumn("last_seen_at", F.lit("a")).withColumn("last_updated_at", F.lit("a"))
    changes = spark.createDataFrame([(1, "updated", "b", None, 2), (1, "updated", "a", "y", 1), (1, "unchanged", "c", "z", 3)], "target_id long, action string, v string, keep string, n int")
    assert [tuple(r) for r in upsert.next_state(state, changes, ["v", "keep"], ["keep"], F.lit("now"), ["n"]).collect()] == [(1, "b", "x", "now", "now")]


def test_objects(spark, tmp_path):
    store = listing.ObjectStore(spark, str(tmp_path / "o"))
    assert store.list() == [] and not store.exists("a/b")
    store.put("a/b", b"\x00one")
    store.put("a/b", b"two")
    store.put("c", b"")
    assert store.get("a/b") == b"two" and store.stat("a/b")[0] == 3 and store.list() == ["a/b", "c"] and store.list("a/") == ["a/b"]
    assert store.delete("c") and not store.delete("c")
    for bad in ("../x", "/x", "a/../b", ""):
        with pytest.raises(ValueError):
            store.put(bad, b"")
    with pytest.raises(FileNotFoundError):
        store.get("none")


def test_maintenance_jobs(spark, small):
    jobs = spark.read.parquet(f"{small}/jobs.parquet")
    now = F.lit(NOW).cast("timestamp")
    errors = spark.createDataFrame([(datetime(2026, 6, 14),), (datetime(2026, 5, 1),), (None,)], "occurred_at timestamp")
    left = maintain.retention({"jobs": jobs, "errors": errors}, now, 180)
    assert left["jobs"].count() == jobs.count() and left["errors"].count() == 2 and left["jobs"].filter("status = 'EXPIRED'").count() > jobs.filter("status = 'EXPIRED'").count()
    for bad in ((0, 0, 5), (30, 60, 5), (90, 60, 0)):
        with pytest.raises(ValueError):
            maintain.checked_window(*bad)
    maintain.checked_window(90, 60, 5)
    after, moved = maintain.reclassify(jobs, F.lit("other"), F.lit("MID"))
    assert after.filter("category_slug <> 'other' or seniority_level <> 'MID'").count() == 0
    assert sum(r["n"] for r in moved.collect()) == jobs.filter("not category_slug <=> 'other'").count()
    assert feed.column_sizes(spark, [f"{small}/jobs.parquet"]).filter("column = 'title' and bytes > 0").count() == 1
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "source string, started_at int, status string")
    ledgers = spark.createDataFrame([("R", 100, 5), ("R", 1, 0), ("S", 2, 0)], "reason string, kept int, overflow int")
    last, reasons = feed.health(runs, ledgers)
    assert {r["status"] for r in last.collect()} == {"y", "z"} and [tuple(r) for r in reasons.collect()] == [("R", 106), ("S", 2)]
    assert [r["v"] for r in feed.top_values(spark.createDataFrame([("a", 3), ("other", 9), ("b", 0), ("c", 4)], "v string, n int"), "v", 12).collect()] == ["c", "a"]


def test_labels(spark):
    pay = lambda *a: spark.range(1).select(display.pay_label(*[F.lit(x) for x in a])).first()[0]
    assert pay(60000.0, 80000.0, "USD", "ANNUAL") == "$60K–$80K" and pay(0.0, 30.5, "EUR", "HOURLY") == "Up to EUR 30.50/hr" and pay(None, None, None, None) is None
    assert pay(13_000_000.0, None, "JPY", "ANNUAL") == "From JPY 13M" and pay(1_250_000.0, 1_250_000.0, None, "ANNUAL") == "$1.3M" and pay(20.0, 20.0, "USD", None) == "$20"
    place = lambda *a: spark.range(1).select(display.place_label(*[F.lit(x).cast("string") for x in a])).first()[0]
    assert [place(None, None, "IN", "REMOTE"), place(None, None, None, "REMOTE"), place("Yell", "OH", "US", "REMOTE"), place(None, None, "US", None), place("", "", "FR", None)] == ["Remote (IN)", "Remote", "Yell, OH", "United States", "Location unknown"]
    assert display.bucket_start("FOUND_TODAY", NOW).hour == 0 and display.bucket_start("FOUND_LAST_HOUR", NOW).hour == 11 and display.bucket_start("OLDER", NOW) is None


def test_nested_record_becomes_a_listing(spark):
    model = '{"title": " Clerk ", "location": {"city": "Yell", "is_remote": "true", "workplace_type": "TBC"}, "compensation": null, "metadata": {"team": "Ops"}, "posted_at": "2026-01-02T03:04:05Z"}'
    import json

    rows = [(1, json.dumps({"id": "board:9", "company_id": 7, "status": "active", "close_time": "2026-01-03T00:00:00Z", "job_model_json": json.dumps(json.dumps(json.loads(model)))})), (2, "{"), (3, None)]
    got = {r["raw_id"]: r for r in listing.normalized(spark.createDataFrame(rows, "raw_id long, payload string"), "s").collect()}
    one = got[1]
    assert (one["external_id"], one["company_external_id"], one["title"], one["raw_city"], one["source_is_remote"], one["raw_workplace_type"], one["department"], one["ats_provider"]) == ("board:9", "7", "Clerk", "Yell", True, None, "Ops", "board")
    assert one["posted_at"] == datetime(2026, 1, 2, 3, 4, 5) and one["closed_at"] is None and got[2]["external_id"] is None and got[3]["title"] is None
