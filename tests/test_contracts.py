import json

import pytest
from pyspark.sql import functions as F

from pagefacts.operators.contracts import contract_rules, schema_issues


@pytest.fixture
def issues(spark):
    def run(value, schema, **more):
        text = value if isinstance(value, str) and more.pop("raw", False) else json.dumps(value)
        rules = contract_rules(spark, {"it": schema, **more})
        frame = spark.createDataFrame([(1, text)], "id long, record string")
        return sorted((r.path, r.message) for r in schema_issues(frame, "record", F.lit("it"), rules, ["id"]).collect())

    return run


def test_unique_items(issues):
    schema = {"type": "array", "uniqueItems": True}
    assert issues(["a", "b"], schema) == []
    assert issues(["a", "a", "a"], schema) == [("$[1]", "unique_items")]
    assert issues([{"key": 1, "b": 2}, {"b": 2, "key": 1}], schema) == [("$[1]", "unique_items")]


def test_date_times(spark):
    wrong = ["2026-06-15", "2026-02-30T12:00:00Z", "2026-06-15T24:00:00Z", "2026-06-15T12:60:00Z", "2026-06-15T12:00:60Z", "2026-06-15T12:00:00+24:00", "2025-02-29T00:00:00Z", ""]
    right = ["2026-06-15T12:00:00Z", "2026-06-15T12:00:00.123Z", "2026-06-15T12:00:00+03:30", "2024-02-29T23:59:59-04:00"]
    frame = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(wrong + right)], "id long, record string")
    rules = contract_rules(spark, {"time": {"type": "string", "format": "date-time"}})
    found = schema_issues(frame, "record", F.lit("time"), rules, ["id"]).collect()
    assert sorted(r.id for r in found) == list(range(len(wrong))) and {(r.path, r.message) for r in found} == {("$", "date_time")}


def test_every_rule(issues):
    schema = {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {
        "a": {"type": ["integer", "null"], "minimum": 2, "maximum": 5}, "b": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"},
        "c": {"const": None}, "d": {"enum": ["x", 1, None, {"k": [1]}]}, "e": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "number"}},
        "f": {"type": "string", "format": "uuid"}, "g": {"type": "object", "properties": {"h": {"type": "boolean"}}, "required": ["h"]}}}
    good = {"a": 2, "b": "ab", "c": None, "d": {"k": [1]}, "e": [1, 2.5], "f": "123e4567-e89b-12d3-a456-426614174000", "g": {"h": True, "more": 1}}
    assert issues(good, schema) == []
    assert issues({**good, "a": None, "d": 1.0}, schema) == []
    bad = {"a": 1.5, "b": "A", "c": 0, "d": "y", "e": [], "f": "no", "g": {}, "z": 1}
    assert issues(bad, schema) == sorted([
        ("$.a", "type"), ("$.b", "min_length"), ("$.b", "pattern"), ("$.c", "const"), ("$.d", "enum"), ("$.e", "min_items"), ("$.f", "uuid"), ("$.g.h", "required"),
        ("$.z", "unexpected")])
    assert issues({"a": 6, "b": "abcd", "e": [1, "x", 3]}, schema) == sorted([("$.a", "maximum"), ("$.b", "max_length"), ("$.e", "max_items"), ("$.e[1]", "type")])
    assert issues([], schema) == [("$", "type")]
    assert issues({"b": "ab\n", "a": 3}, schema) == [("$.b", "pattern")]


def test_references_and_all_of(issues):
    base = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}}}
    schema = {"allOf": [{"$ref": "base"}], "type": "object", "properties": {"id": {}, "items": {"type": "array", "items": {"$ref": "base"}}}, "additionalProperties": False}
    assert issues({"id": 1, "items": [{"id": 2}]}, schema, base=base) == []
    assert issues({"items": [{"id": "2"}, 3]}, schema, base=base) == sorted([("$.id", "required"), ("$.items[0].id", "type"), ("$.items[1]", "type")])
    assert issues(1, {"$ref": "nowhere"}) == [("$", "unresolved")]
    with pytest.raises(ValueError):
        issues(1, {"properties": {"a": {"$ref": "it"}}})


def test_alternatives(issues):
    inner = {"anyOf": [{"type": "null"}, {"type": "array", "items": {"type": "integer"}}]}
    schema = {"type": "object", "properties": {"v": {"anyOf": [{"type": "string"}, {"type": "object", "required": ["n"], "properties": {"n": inner}}]}}}
    for good in ("text", {"n": None}, {"n": [1, 2]}):
        assert issues({"v": good}, schema) == []
    for bad in (1, {}, {"n": "x"}, {"n": [1, "x"]}):
        assert issues({"v": bad}, schema) == [("$.v", "any_of")]
    assert issues(3, {"anyOf": [{}, {"type": "null"}]}) == []


def test_schema_of_other_keys(issues):
    schema = {"type": "object", "properties": {"name": {"type": "string"}}, "additionalProperties": {"type": "integer", "minimum": 0}}
    assert issues({"name": "x", "a": 1, "b": 2}, schema) == []
    assert issues({"name": 1, "a": -1, "b": "x"}, schema) == [("$.a", "minimum"), ("$.b", "type"), ("$.name", "type")]


def test_odd_records(spark):
    rules = contract_rules(spark, {"it": {"type": "object"}})
    frame = spark.createDataFrame([(1, "{", "it"), (2, None, "it"), (3, "{}", "else"), (4, "{}", None), (5, "{}", "it")], "id long, record string, name string")
    found = sorted((r.id, r.path, r.message) for r in schema_issues(frame, "record", F.col("name"), rules, ["id"]).collect())
    assert found == [(1, "$", "malformed"), (2, "$", "malformed"), (3, "$", "contract_unknown"), (4, "$", "contract_unknown")]
    assert schema_issues(frame.limit(0), "record", F.col("name"), rules, ["id"]).count() == 0
