from __future__ import annotations

import json

import pytest

from millrace.operators import nested

SLOT = {"slot_id": "T1", "day": "Mon"}
MODEL = {
    "openings": [{"opening_id": "O1", "shifts": {"0": {"shift_id": "S1", "slots": json.dumps([SLOT, None, {"slot_id": "T2"}])}, "1": None}}, None],
    "compensation": {"bands": {"band_id": "B1", "components": [{"component_id": "C1", "amount": 5}]}},
    "application": {"form": {"questions": [{"question_id": "Q1", "options": None}, {"options": [{"option_id": "X1"}]}]}},
}
WANT = [
    ("band", "B1"), ("component", "B1/C1"), ("opening", "O1"), ("option", "/X1"), ("question", ""), ("question", "Q1"),
    ("shift", "O1/S1"), ("slot", "O1/S1/T1"), ("slot", "O1/S1/T2"),
]


@pytest.mark.parametrize("layers", [0, 1, 2])
def test_every_way_to_write_an_array(spark, layers):
    body: object = MODEL
    for _ in range(layers):
        body = json.dumps(body)
    df = spark.createDataFrame([(1, json.dumps({"job_model_json": body}))], "raw_id long, payload string")
    assert sorted((r["entity"], r["id_path"]) for r in nested.flatten(df).collect()) == WANT


def test_intervals_hold_their_children(spark):
    df = spark.createDataFrame([(1, json.dumps({"job_model_json": MODEL}))] * 2, "raw_id long, payload string")
    rows = nested.flatten(df).collect()
    assert len(rows) == 2 * len(WANT)
    for doc in {r["doc_no"] for r in rows}:
        own = {r["pre"]: r for r in rows if r["doc_no"] == doc}
        for r in own.values():
            if r["depth"] > 1:
                p = own[r["parent_pre"]]
                assert p["pre"] < r["pre"] and p["post"] > r["post"] and p["depth"] == r["depth"] - 1
            else:
                assert r["parent_pre"] is None


def test_broken_empty_and_long_payloads(spark):
    many = {"openings": [{"opening_id": f"O{i}", "shifts": [{"shift_id": "S"}]} for i in range(3000)]}
    odd = {"openings": [{"opening_id": "\ud800"}, {"opening_id": 7}]}
    rows = [(1, None), (None, "{broken"), (3, "[]"), (4, ""), (5, '{"job_model_json": "n/a"}'), (6, "null"), (7, "[" * 100000), (8, json.dumps({"job_model_json": many})), (None, json.dumps({"job_model_json": odd}))]
    df = spark.createDataFrame(rows, "raw_id long, payload string").selectExpr("*", "1 as doc_no", "2 as entity")
    got = nested.flatten(df).groupBy("raw_id", "entity").count().collect()
    assert {(r["raw_id"], r["entity"]): r["count"] for r in got} == {(8, "opening"): 3000, (8, "shift"): 3000, (None, "opening"): 2}
    assert nested.flatten(df.limit(0)).count() == 0
