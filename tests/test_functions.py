from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import classify, dedupe, freshness, jsonx, location, search, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTPS://WWW.Example.com:443/Jobs/AbC/?utm_source=x&b=2&a=1&empty=#top", "https://example.com/Jobs/AbC?a=1&b=2"), ("http://example.com", "http://example.com/"),
        ("https://example.com/a b?q=x%20y", "https://example.com/a b?q=x+y"), ("https://e.com/?q=~*", "https://e.com/?q=~%2A"), ("ftp://example.com/x", None), ("nonsense", None), ("", None), (None, None), ("https:///x", None), ("http://me@E.com:443/x//?p=100%&q=%41", "http://me@e.com/x?p=100%25&q=A"),
        (" https://e.com/x/?REF=board ", "https://e.com/x"),
    ],
)
def test_addresses(spark, raw, want):
    assert one(spark, raw, urls.canonical) == want


@pytest.mark.parametrize("f, raw, want", [
    (text.title_case, "oil and gas", "Oil and Gas"), (text.title_case, "transportation/trucking", "Transportation/Trucking"), (text.title_case, "IT", "It"), (text.title_case, " ", None),
    (text.title_key, "Senior Front-End Engineer (Remote)", "front"), (text.title_key, "Lead", "lead"), (text.title_key, "Sr. Clerk II [x]", "clerk"), (text.company_key, "Acme Holdings, Inc.", "acme"),
    (text.clean, "  x​", "x"), (text.clean, "\t", None), (text.domain, "https://www.Acme.example:8080/x", "acme.example"), (text.domain, "acme", None), (text.prefix, "a:b:c", "a"), (text.prefix, "abc", None),
    (text.currency_code, " usd", "USD"), (text.currency_code, "US$", None), (text.redact, "postgres://me:secret@h/db token=abc", "postgres://me:***@h/db token=***"),
])
def test_texts(spark, f, raw, want):
    assert one(spark, raw, f) == want


def test_nested_json(spark):
    f = lambda c: jsonx.member(jsonx.decoded(c), "$.a")
    for raw, want in (('{"a": "x"}', "x"), ('"{\\"a\\": \\"x\\"}"', "x"), ("[1]", None), ("{", None), (None, None), ('"a"', None)):
        assert one(spark, raw, f) == want
    assert [one(spark, x, jsonx.number) for x in ("1.5", "NaN", "inf", "true", None)] == [1.5, None, None, None, None]
    assert [one(spark, x, jsonx.boolean) for x in ("YES", "0", "maybe")] == [True, False, None]
    assert one(spark, "2026", jsonx.instant) is None and one(spark, "2026-01-02T03:04:05Z", jsonx.instant) is not None
    assert len(one(spark, "y" * 9000, jsonx.envelope)) < 8100


def test_freshness(spark):
    now = F.lit(datetime(2026, 1, 10, 12, tzinfo=timezone.utc)).cast("timestamp")
    at = lambda s: F.to_timestamp(F.lit(s))
    rows = spark.range(1).select(
        freshness.assess(at("2026-01-12 00:00:00"), now)["reason"], freshness.assess(at("1999-01-01"), now)["reason"], freshness.assess(F.lit(None).cast("timestamp"), now)["valid"],
        freshness.bucket(F.lit("ACTIVE"), at("2026-01-10 11:30:00"), at("2026-01-01"), F.lit(True), at("2026-01-01"), now), freshness.relative_label(at("2026-01-10 09:00:00"), now),
        freshness.bucket(F.lit("ACTIVE"), at("2026-01-01"), at("2026-01-01"), F.lit(True), at("2026-01-10 01:00:00"), now),
    ).first()
    assert tuple(rows) == ("FUTURE_POSTED_AT", "IMPLAUSIBLE_POSTED_AT", False, "FOUND_LAST_HOUR", "3h ago", "UPDATED_TODAY")


def test_rules_in_order(spark):
    df = spark.createDataFrame([("Data Engineer", "Sales", None), ("Wizard", "Sales", "Mid-Senior level"), ("Chief Cook", None, ""), ("Junior Director", None, "x")], "t string, d string, s string")
    got = df.select(classify.category(F.col("t"), F.col("d")), classify.level(F.col("t"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("data-engineering", "UNKNOWN"), ("sales", "SENIOR"), ("food-hospitality", "EXECUTIVE"), ("management", "DIRECTOR")]


GOLDEN_TITLES = (
    ("Night Nurse, RN", "healthcare"), ("Dental Aide", "healthcare"), ("Direct Support Worker", "healthcare"), ("Patient Driver", "healthcare"), ("Primary School Teacher", "education"), ("Swim Coach", "education"),
    ("Workday Integration Developer", "workday"), ("Analytics Engineer", "data-engineering"), ("ETL Developer", "data-engineering"), ("Junior Data Analyst", "data-analytics"), ("Staff Data Scientist", "data-science"),
    ("AI Lead", "data-science"), ("CNC Programmer", "manufacturing"), ("Full-Stack Developer", "software"), ("Site Reliability Lead", "software"), ("Help-Desk Agent", "it-ops"), ("Civil Engineer II", "engineering"),
    ("Marine Biologist", "science"), ("HVAC Technician", "skilled-trades"), ("Manufacturing Associate", "manufacturing"), ("Housekeeping Lead", "construction"), ("CDL Driver", "transport"), ("Line Cook", "food-hospitality"),
    ("Head Cashier", "retail-customer"), ("Account Executive", "sales"), ("SEO Writer", "marketing"), ("Payroll Clerk", "finance"), ("Paralegal", "legal"), ("Recruiting Partner", "hr"), ("Social Worker", "social-services"),
    ("Security Guard", "security"), ("Receptionist", "admin"), ("General Manager", "management"), ("Wizard", "other"), ("", "other"), (None, "other"), ("Data  Wizard", "other"), ("Raiser", "other"),
)
GOLDEN_LEVELS = (
    ("Vice President, Senior Sales", "EXECUTIVE"), ("Senior Director", "DIRECTOR"), ("Senior Store Manager", "MANAGER"), ("Principal Engineer", "LEAD"), ("Sr. Clerk", "SENIOR"), ("Clerk III", "SENIOR"),
    ("Software Intern", "INTERNSHIP"), ("Internal Auditor", "UNKNOWN"), ("Co-op Student", "INTERNSHIP"), ("Assistant Cook", "ENTRY"), ("Welder I", "ENTRY"), ("Leading Light", "UNKNOWN"), (None, "UNKNOWN"),
)


def test_titles_and_levels(spark):
    df = spark.createDataFrame([(t, "Sales" if t == "" else None, w) for t, w in GOLDEN_TITLES], "t string, d string, w string")
    assert df.select("t", "w", classify.category(F.col("t"), F.col("d")).alias("c")).filter("c <> w").collect() == []
    df = spark.createDataFrame(GOLDEN_LEVELS, "t string, w string")
    assert df.select("t", "w", classify.level(F.col("t"), F.lit("Not Applicable")).alias("c")).filter("c <> w").collect() == []
    slugs = {s for s, _ in classify.CATEGORIES}
    assert {r.name for r in classify.CATEGORY_RULES} == slugs - {"other"} and {r.name for r in classify.LEVEL_RULES} <= set(classify.LEVELS) and classify.categories(spark).count() == 26


def test_keys(spark):
    df = spark.createDataFrame([("Acme Inc", "Senior Welder", "US", "OH", "Yell", "Text  here"), ("ACME", "Welder - nights", "US", "OH", "yell", "text here"), ("Acme", "Manager", "US", "OH", "Yell", None)], "c string, t string, n string, s string, p string, d string")
    cols = [F.col(x) for x in "ctnsp"]
    rows = df.select(dedupe.fingerprint(*cols, F.col("d")).alias("f"), dedupe.title_and_place(*cols).alias("l")).collect()
    assert rows[0]["f"] == rows[1]["f"] != rows[2]["f"] and rows[0]["l"] == rows[1]["l"] and rows[2]["l"] is None


def place(spark, country=None, state=None, city=None, postal=None, where=None, workplace=None, remote=None, company=None, **lists):
    df = spark.createDataFrame([(country, state, city, postal, where, workplace, remote, company)], "a string, b string, c string, d string, e string, f string, g boolean, h string")
    return location.resolve(df, tuple("abcdefg"), "h", **lists).select("where.*").first()


def test_places(spark):
    r = place(spark, "US", "Ohio", "Yell", "44101-1234", "Yell, OH", "hybrid")
    assert (r.country_code, r.state_code, r.city, r.postal_code, r.remote_type, r.reason) == ("US", "OH", "Yell", "44101", "HYBRID", None)
    assert place(spark, None, "Ontario", "Yell").reason == "FOREIGN_SUBDIVISION"
    assert (lambda x: (x.country_code, x.state_code))(place(spark, None, "MH", "Pune")) == ("IN", "MH")
    assert place(spark, "IN").country_code is None and place(spark, "DE").country_code is None and place(spark, "FR").country_code == "FR"
    assert (lambda x: (x.country_code, x.state_code, x.city))(place(spark, where="Building 4, Yell, MI 48201")) == ("US", "MI", "Yell")
    assert place(spark, city="Springfield").reason == "CITY_ONLY" and place(spark).reason == "NO_LOCATION"
    assert place(spark, where="Remote - USA").country_code == "US" and place(spark, where="Remote - USA").remote_type == "REMOTE"
    assert place(spark, "US", None, "Yell", company="Germany").reason == "UNSUPPORTED_CLAIM" and place(spark, "US", "OH", "Yell", company="Germany").country_code == "US"
    assert place(spark, "US", "Goa", "Yell").reason == "FOREIGN_SUBDIVISION" and place(spark, "Canada", "Ontario", "Yell").country_code is None
    assert (lambda x: (x.country_code, x.state_code, x.city))(place(spark, city="TX")) == ("US", "TX", None)
    assert place(spark, where="OH 45324").state_code is None and place(spark, where="  South Carolina").state_code == "SC"
    listed = "place_id long, place_level string, city string, state_code string, state_name string, country_code string, country_name string, alt_names string"
    rows = [(1, "city", "Garrow", "NY", None, "US", None, "Gw City|The Garrow"), (2, "city", "Pellpur", "MH", None, "IN", None, None), (3, "city", "Dunwick", "ON", None, "CA", None, None), (4, "city", "Dunwick", "IL", None, "US", None, None), (5, "city", "Tarn", "ON", None, "CA", None, None), (6, "state", None, "NY", None, "US", None, None)]
    cities = location.city_facts(spark.createDataFrame(rows, listed))
    at = lambda *a, **k: (lambda x: (x.country_code, x.state_code, x.city, x.reason))(place(spark, *a, cities=cities, **k))
    assert at(city="Gw City") == ("US", "NY", "Garrow", None) and at("India", city="Pellpur") == ("IN", "MH", "Pellpur", None)
    assert at("US", city="Tarn") == (None, None, "Tarn", "UNSUPPORTED_CLAIM") and at("US", "OH", "Tarn")[0] is None and at("India", city="Tarn")[0] == "IN"
    assert at("US", city="Dunwick")[3] == "UNSUPPORTED_CLAIM" and at("US", "IL", "Dunwick")[1] == "IL" and at(city="Garrow")[3] == "CITY_ONLY"


def test_search(spark):
    df = spark.createDataFrame([(1, "Planning menus daily"), (2, "menu for the planning team"), (3, "nothing"), (4, None)], "id int, t string").select("id", search.document(F.col("t")).alias("d"))
    hits = lambda q: [r[0] for r in df.filter(search.matches(F.col("d"), search.parse(q))).orderBy("id").collect()]
    assert hits("menu plan") == hits("menus planning") == [1, 2] and hits("men plan") == [] and hits('"planning menu"') == [1] and hits("menu -daily") == [2] and hits("nothing or daily") == [1, 3]
    assert hits("") == hits('"') == hits("the") == [] and hits("or or") == []
    index = search.terms(df, "id", F.col("d")).cache()
    for q in ("menu plan", '"planning menu"', "menu -daily", "nothing or daily", "zzz"):
        assert set(hits(q)) <= {r[0] for r in search.candidates(index, search.parse(q)).collect()} <= {1, 2, 3}
    assert search.candidates(index, search.parse("")).count() == 0 and sorted(r[0] for r in search.candidates(index, search.parse("teams planned")).collect()) == [2]
    assert {"plan", "plans", "planned", "planning"} <= set(search.inflections("planned")) and search.inflections("c3") == ("c3",) and "studies" in search.inflections("study")
    ranks = {r[0]: r[1] for r in df.select("id", search.rank([F.col("d")], search.parse("menu"))).collect()}
    assert ranks[1] > 0 and ranks[3] == 0
