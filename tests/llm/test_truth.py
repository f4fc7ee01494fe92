from __future__ import annotations

from datetime import datetime

import pytest

from millrace.llm import truth

SCHEMA = (
    "source_row_id long, source string, apply_url_hash string, content_fingerprint string, title string, department string, seniority string, city string, state_code string, employment_type string, "
    "salary_min double, salary_max double, salary_currency string, last_updated_at timestamp"
)
SOURCES = [("good", 1), ("fair", 2), ("poor", 5)]


def row(i, source, url, print_, updated=1, title="Clerk", department="Sales", seniority="MID", city="Yell", state="IN", kind="FULL_TIME", low=1.0, high=2.0, currency="USD"):
    at = datetime(2025, 1, updated) if updated else None
    return (i, source, url, print_, title, department, seniority, city, state, kind, low, high, currency, at)


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as group_id", "2 as trust"), spark.createDataFrame(SOURCES, "source string, trust_rank int")


def best(spark, rows):
    return {r["group_id"]: r["best_source_row_id"] for r in truth.representatives(*frames(spark, rows)).collect()}


def test_groups_and_dominance(spark):
    rows = [
        row(1, "poor", "a", "p1", 1, department="TBD"), row(2, "good", "a", "p2", 3), row(3, "fair", None, "p2", 2, city=" "),  # 1-2 by url, 2-3 by print
        row(4, "good", None, "p4", 9), row(5, "good", "z", "p5", 9),  # alone
        row(6, "poor", "b", "p6", 2), row(7, "poor", "b", "p7", 2, city="n/a"), row(8, None, "b", "p8", None),
    ]
    assert best(spark, rows) == {1: 2, 6: 6}


def test_truth_decides_between_rows_none_of_which_beats_the_other(spark):
    # Row 11 is newer, row 10 more trusted; the others agree with row 11's city.
    rows = [row(10, "good", "a", "p", 1, city="Wrongton"), row(11, "fair", "a", "q", 5, city="Yell"), row(12, "poor", "a", "r", 1, city="Yell"), row(13, "fair", "a", "s", 1, city="Yell")]
    assert best(spark, rows)[10] == 11


def test_the_score_decides_within_dominance_only(spark):
    # Nobody beats 1, 2 or 3; 4 has the most likely values but 2 beats it. Other groups teach the model that "poor" errs.
    rows = [row(1, "poor", "a", None, 9, city="Wrongton", department="Slaes"), row(2, "good", "a", None, 5), row(3, "fair", "a", None, 6, city="Elseton"), row(4, "good", "a", None, 4)]
    rows += [row(100 + 3 * g + k, s, f"g{g}", None, 1 + k, city=f"Hull{g}" if s == "poor" else f"Mull{g}" if s == "fair" and g % 3 == 0 else "Yell") for g in range(12) for k, s in enumerate(("good", "fair", "poor"))]
    assert best(spark, rows)[1] == 2
    got = {r["source_row_id"]: (r["beaten"],) for r in truth.dominance(truth.grouped_rows(*frames(spark, rows))).filter("group_id = 1").collect()}
    assert got == {1: (False,), 2: (False,), 3: (False,), 4: (True,)}


def test_edges(spark):
    same = [row(1, "good", "a", None)] * 3
    assert best(spark, same) == {}  # one row delivered three times
    ties = [row(5, "good", "a", None), row(4, "good", "a", None), row(None, "good", "a", None)]
    assert best(spark, ties) == {4: 4}
    bare = [row(i, None, "u", None, None, *[None] * 9) for i in (3, 2)]
    assert best(spark, bare) == {2: 2}
    assert best(spark, [row(1, "good", None, None), row(2, "good", None, None)]) == {}


def test_chains_of_keys_are_one_group(spark):
    rows = [row(i, "good", f"u{i // 2}", f"f{(i + 1) // 2}", 1 + (i == 7)) for i in range(60)]
    assert best(spark, rows) == {0: 7}


def test_survivors_keep_every_true_value(spark):
    rows = [row(i, s, f"g{g}", None, title=t) for g in range(40) for i, s, t in ((3 * g, "good", "Clerk"), (3 * g + 1, "fair", "Clerk"), (3 * g + 2, "poor", "Clrek" if g % 2 else "Clerk"))]
    got = {(r["group_id"], r["field"]): r for r in truth.survivors(*frames(spark, rows)).collect()}
    assert got[(3, "title")]["value"] == "Clerk" and "Clerk" in got[(3, "title")]["true_values"] and got[(3, "title")]["probability"] > 0.5
    params = truth.infer(truth.facts(truth.grouped_rows(*frames(spark, rows)), ("title",)))
    assert params["poor"][0] < params["good"][0] and params["poor"][1] >= params["good"][1]


def test_unknown_sources_keep_their_names_and_votes(spark):
    rows = truth.grouped_rows(*frames(spark, [row(1, "good", "a", None), row(2, "new1", "a", None, city="Hull"), row(3, "new2", "a", None, city="Hull"), row(4, None, "a", None, city="Hull")]))
    assert {(r["source_name"], r["trust"]) for r in rows.collect()} == {("good", 1), ("new1", 2**31 - 1), ("new2", 2**31 - 1), (truth.OTHER_SOURCE, 2**31 - 1)}
    said = {r["value"]: r["said"] for r in truth.facts(rows, ("city",)).collect()}
    assert said["Hull"] == [truth.OTHER_SOURCE, "new1", "new2"]


def test_rates_settle_or_fail(spark):
    rows = [row(i, s, f"g{g}", None, city=c) for g in range(9) for i, s, c in ((3 * g, "good", "Yell"), (3 * g + 1, "fair", "Yell"), (3 * g + 2, "poor", f"Hull{g}"))]
    known = truth.facts(truth.grouped_rows(*frames(spark, rows)), ("city",))
    with pytest.raises(RuntimeError, match="not settled after 1 rounds"):
        truth.infer(known, rounds=1)
    assert set(truth.infer(known)) == {"good", "fair", "poor"}
