from __future__ import annotations

import pytest

from millrace.llm import places

LIST = [
    (1, "country", None, None, None, "US", "United States", None), (2, "country", None, None, None, "IN", "India", None), (3, "country", None, None, None, "CA", "Canada", None),
    (11, "state", None, "IN", "Indiana", "US", "United States", None), (12, "state", None, "CA", "California", "US", "United States", None), (13, "state", None, "TN", "Tennessee", "US", "United States", None),
    (14, "state", None, "TN", "Tamil Nadu", "IN", "India", None), (15, "state", None, "QC", "Quebec", "CA", "Canada", None), (16, "state", None, "NC", "North Carolina", "US", "United States", None),
    (101, "city", "Mount Fallowmere", "IN", "Indiana", "US", "United States", None), (102, "city", "Port Garrowick", "CA", "California", "US", "United States", "Yellmarsh"),
    (103, "city", "Dunbrackle", "TN", "Tennessee", "US", "United States", None), (104, "city", "Dunbrackle", "TN", "Tamil Nadu", "IN", "India", None), (105, "city", "Nörthquay Heights", "QC", "Quebec", "CA", "Canada", None),
]
CASES = [
    (("Mount Fallowmere", "IN", "US"), 101), (("Mt. Fallowmere", None, None), 101), (("mount falowmere", None, "USA"), 101), (("Mount Fallowmree", None, ""), 101), (("MountFallowmere", None, None), 101),
    (("Mount Fallowmere (HQ)", None, None), 101), (("Greater Mount Fallowmere Area", None, None), 101), (("Mount Fallowmere IN 46001", None, None), 101), ((None, "Mount Fallowmere, IN", None), 101),
    (("Yellmarsh", None, None), 102), (("Port Garrowick - CA, US", None, None), 102), (("northquay hts", "Québec", "Kanada"), 105), (("Northquay Heights, CA", None, None), 105),
    (("Dunbrackle", None, None), 0), (("Dunbrackle", None, "Bharat"), 104), (("Dunbrackle", "Tenn.", None), 103), (("Dunbrackle", "TN", "Unted States"), 103), (("Dunbrackle", "TN", None), 0),
    (("Fallowmere", None, None), 0), (("Mount Quarrelby", "IN", "US"), 0), (("Remote", None, "US"), 0), (("see description", "CA", None), 0), (("Mount Fallowmere", "CA", "US"), 0),
    ((None, "IN", None), 11), ((None, None, "IN"), 2), ((None, "CA", "US"), 12), ((None, None, "CA"), 3), ((None, "State of California", None), 12), ((None, "N. Carolina", "United  States"), 16), ((None, "Califrnia", None), 12),
    (("Quebec", None, None), 15), ((None, "United States", None), 1), ((None, "TN", None), 0), ((None, "TN", "IN"), 14), ((" ​", "\t", "U.S.A."), 1), (("x" * 20000, None, "US"), 0), (("46001", None, "US"), 1),
]


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame(LIST, listing_schema)


listing_schema = "place_id long, place_level string, city string, state_code string, state_name string, country_code string, country_name string, alt_names string"


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id long, raw_city string, raw_state string, raw_country string").selectExpr("*", "1 as token", "2 as n_rows")


def test_entries(spark, listing):
    rows = [(i, *c[0]) for i, c in enumerate(CASES)] + [(900, None, " ", ""), (None, "Yellmarsh", None, None), (None, "Yellmarsh", None, None)]
    got = [(r[0], r[1]) for r in places.resolve(frame(spark, rows), listing).collect()]
    by = dict(got)
    assert [(c, by.get(i)) for i, c in enumerate(CASES) if by.get(i) != c[1]] == []
    assert 900 not in by and got.count((None, 102)) == 2


def test_empty_tables_and_unmatched(spark, listing):
    df = frame(spark, [(1, "Nowhere", None, None), (2, "Nowhere", None, None), (3, None, None, "US")])
    assert places.resolve(df.limit(0), listing).count() == 0
    assert {r[1] for r in places.resolve(df, listing.limit(0)).collect()} == {0}
    assert [tuple(r) for r in places.unmatched(df, listing).collect()] == [("Nowhere", None, None, 2)]


def test_repairs_are_single_edits(spark):
    words = ["fallowmere", "falls", "in"]
    tokens = spark.createDataFrame([(t,) for t in ("fallowmere", "falowmere", "fallowmerre", "fallovmere", "fallwomere", "falowmree", "in", "im", "fals", "")], "token string")
    got = {r["token"]: {w["word"] for w in r["words"]} for r in places.repairs(tokens, spark.createDataFrame([(w, [w]) for w in words], "word string, reading array<string>")).collect()}
    assert got == {**{t: {"fallowmere"} for t in ("fallowmere", "falowmere", "fallowmerre", "fallovmere", "fallwomere")}, "in": {"in"}, "fals": {"falls"}}


def test_long_names_with_many_repairs_per_word_are_read():
    right, wrong = [f"right{k}" for k in "abcdefg"], [f"wrong{k}" for k in "abcdefg"]
    rows = [(1, "state", "RR", "US", right, [1.0] * 7, right[0]), (2, "state", "WW", "US", wrong[::-1], [1.0] * 7, wrong[0])]
    typed = tuple(f"typed{k}" for k in "abcdefg")
    repairs = {t: [((w,), 0.9), ((r,), 0.8)] for t, w, r in zip(typed, wrong, right)}
    assert places.Gazetteer(rows, 1.0)._named(typed, repairs) == [("state", ("US", "RR"))]


def test_words_without_partner_refuse_and_weights_rank():
    rows = [(1, "city", "A", "US", ["port", "quill"], [0.5, 2.0], "quill"), (2, "city", "B", "US", ["quill"], [2.0], "quill")]
    reader = places.Gazetteer(rows, 2.0)
    scores = reader._scored([{"port": 1.0}, {"quill": 0.8}])
    assert set(scores) == {1} and abs(scores[1] - (0.25 + 0.8 * 4) / 4.25) < 1e-9
    assert reader._scored([{"quill": 1.0}, {}]) == {} and reader._scored([{"port": 1.0}]) == {} and set(reader._scored([{"quill": 0.8}])) == {2}


def test_a_list_of_many_entries_and_own_aliases(spark):
    made = lambda i: "".join("bdfgklmn"[i >> k & 7] + "aeio"[i >> k & 3] for k in range(0, 15, 3))
    cities = spark.range(30_000).collect()
    listing = spark.createDataFrame(
        [(r[0] + 1000, "city", f"{made(r[0])} {made(r[0] * 7 + 3)}", "ZZ", "Zedland", "QQ", "Quarria", None) for r in cities] + [(1, "state", None, "ZZ", "Zedland", "QQ", "Quarria", None), (2, "country", None, None, None, "QQ", "Quarria", None)],
        listing_schema,
    )
    aliases = spark.createDataFrame([("country", "QQ", None, "old quarry", None), ("word", None, None, made(9)[:3], made(9))], places.ALIASES)
    df = frame(spark, [(1, f"{made(5)} {made(38)}", None, None), (2, made(5), None, None), (3, None, None, "Old Quarry"), (4, f"{made(9)[:3]} {made(66)}", "zedland", None)])
    assert {r[0]: r[1] for r in places.resolve(df, listing, aliases=aliases).collect()} == {1: 1005, 2: 0, 3: 2, 4: 1009}
