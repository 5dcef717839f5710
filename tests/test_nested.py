from __future__ import annotations

import json

import pytest

from paperloom.operators.nested import child_table, flatten_records

WORK = {
    "authorships": [
        {"author": {"display_name": "A"}, "institutions": [{"id": "I1", "departments": [{"name": "D1"}, None, {"name": "D2"}]}, None, {"id": "I2", "departments": {"name": "D3"}}]},
        None,
        {"author": {"display_name": None}, "institutions": {"id": "I3", "departments": []}},
        {"author": None, "institutions": None},
    ],
    "locations": {"id": "L1"},
}
ROWS = {
    ("author", "0", "A"), ("institution", "0/0", "I1"), ("institution", "0/2", "I2"), ("institution", "2/0", "I3"),
    ("department", "0/0/0", "D1"), ("department", "0/0/2", "D2"), ("department", "0/2/0", "D3"), ("location", "0", "L1"),
}


def rows(spark, raws, schema="id long, raw string"):
    df = spark.createDataFrame(raws, schema)
    return [(r.record_id, r.child, r.path, r.item) for r in flatten_records(df).collect()]


@pytest.mark.parametrize("wrap", [json.dumps, lambda w: json.dumps(json.dumps(w)), lambda w: json.dumps({"meta": {}, "results": [w]}), lambda w: json.dumps([w]), lambda w: json.dumps({"results": w})])
def test_every_wrapping(spark, wrap):
    assert {r[1:] for r in rows(spark, [(1, wrap(WORK))])} == ROWS


def test_unreadable_and_odd(spark):
    raws = [(1, None), (2, ""), (3, '{"authors":["x"'), (4, "<html>"), (5, "null"), (6, '"text"'), (7, "[]"), (8, "12"), (9, '{"authors":"Solo"}'), (10, '{"authors":["x",null,"","y"]}'), (11, '{"authorships":"n/a"}')]
    assert sorted(rows(spark, raws)) == [(9, "author", "0", "Solo"), (10, "author", "0", "x"), (10, "author", "3", "y")]


def test_long_record_and_clashing_columns(spark):
    names = [f"n{i}" for i in range(3000)]
    got = rows(spark, [(1, json.dumps({"authors": names}), "c", "p")], "id long, raw string, child string, path string")
    assert len(got) == 3000 and (1, "author", "2999", "n2999") in got


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_parents(spark):
    df = spark.createDataFrame([(1, json.dumps(WORK))], "id long, raw string")
    got = {(r.path, r.parent_path, r.item) for r in child_table(df, "department").collect()}
    assert got == {("0/0/0", "0/0", "D1"), ("0/0/2", "0/0", "D2"), ("0/2/0", "0/2", "D3")}
    with pytest.raises(ValueError):
        child_table(df, "nothing")
