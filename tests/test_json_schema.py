"""JSON Schema predicates: verdicts of the specification's rules, keyword by keyword."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkfold.operators.json_schema import JsonSchema

TREE = {"$id": "https://x.example/tree", "type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "required": ["v"], "additionalProperties": False}
CASES = [
    ({"type": "integer"}, [1, 1.0, -3, 10**20], [1.5, "1", True, None, [1], {}]),
    ({"type": ["string", "null"]}, ["a", None], [1, []]),
    ({"type": "number"}, [1, 2.5, 1e300], ["1", False]),
    ({"type": "object"}, [{}, {"a": 1}], [[], "a"]),
    ({"type": "array"}, [[], [1, "a"]], [{}, 1]),
    ({"type": "boolean"}, [True, False], [0, "true", None]),
    ({"const": {"a": [1, 2], "b": None}}, [{"b": None, "a": [1, 2]}], [{"a": [2, 1], "b": None}, {"a": [1, 2]}]),
    ({"const": 2}, [2, 2.0], [3, "2", True]),
    ({"enum": ["a", 1, None, [1]]}, ["a", 1, None, [1]], ["b", 2, [1, 2], False]),
    ({"enum": [False]}, [False], [0, None]),
    ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.9, "text"], [0.9, 3, 4]),
    ({"exclusiveMinimum": 0, "maximum": 5}, [0.1, 5], [0, 5.1]),
    ({"multipleOf": 0.01}, [1.23, 5, "x"], [1.234]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "日本語", 5], ["a", "abcd", "🎉"]),
    ({"pattern": "b+c"}, ["abbc!", 1], ["ac"]),
    ({"format": "date"}, ["2024-02-29", 5], ["2023-02-29", "2024-1-1", "x"]),
    ({"format": "date-time"}, ["2024-02-29T10:00:00Z", "2024-01-01t23:59:59.5+02:00"], ["2024-02-30T10:00:00Z", "2024-01-01", "2024-01-01T25:00:00Z"]),
    ({"format": "ipv4"}, ["1.2.3.4", "255.255.255.255"], ["1.2.3", "256.1.1.1", "1.2.3.4."]),
    ({"format": "unknown-thing"}, ["anything"], []),
    ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], "x"], [[], [1, 2, 3]]),
    ({"uniqueItems": True}, [[1, 2, "1"], [], [{"a": 1}, {"a": 2}]], [[1, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ({"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False}, [[1, "a"], [1], []], [["a"], [1, 2], [1, "a", 3]]),
    ({"items": {"type": "integer"}}, [[1, 2], [], {}], [[1, "a"]]),
    ({"contains": {"minimum": 5}, "maxContains": 2}, [[1, 6], [5, 6]], [[1], [], [5, 6, 7]]),
    ({"contains": {"minimum": 5}, "minContains": 0}, [[], [1]], []),
    ({"required": ["a", "b c"]}, [{"a": None, "b c": 1}, 3], [{"a": 1}, {}]),
    ({"properties": {"a": {"type": "integer"}, "b": False}}, [{"a": 1}, {"c": "x"}, []], [{"a": "x"}, {"b": 1}]),
    ({"properties": {'q"': {"type": "integer"}}}, [{'q"': 1}], [{'q"': "x"}]),
    ({"patternProperties": {"^n": {"type": "integer"}, "x$": {"minimum": 5}}}, [{"n": 1, "z": "a"}, {"nx": 7}], [{"n": "a"}, {"nx": 3}]),
    ({"properties": {"a": {}}, "patternProperties": {"^b": {}}, "additionalProperties": False}, [{"a": 1, "b1": 2}], [{"c": 1}]),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}}, [{"a": 1, "x": "y"}], [{"x": 1}]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, {}], [{"abc": 1}]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"a": 1, "b": 2, "c": 3}]),
    ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 2}], [{"a": 1}]),
    ({"dependentSchemas": {"a": {"properties": {"b": {"type": "integer"}}, "required": ["b"]}}}, [{"a": 1, "b": 2}, {}], [{"a": 1, "b": "x"}]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [1]),
    ({"oneOf": [{"multipleOf": 3}, {"multipleOf": 5}]}, [3, 5], [15, 2]),
    ({"not": {"type": "string"}}, [1, None], ["a"]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, [{"k": 1, "a": 1}, {"b": 1}], [{"k": 1, "b": 1}, {"k": 2}]),
    ({"$ref": "#/$defs/pos~1x", "$defs": {"pos/x": {"exclusiveMinimum": 0}}, "maximum": 9}, [1], [0, 10]),
    ({"$ref": "#here", "$defs": {"a": {"$anchor": "here", "type": "string"}}}, ["a"], [1]),
    ({"$id": "https://x.example/root", "properties": {"t": {"$ref": "tree"}}}, [{"t": {"v": 1, "kids": [{"v": 2}]}}], [{"t": {"v": "a"}}, {"t": {"v": 1, "kids": [{"v": 2, "x": 1}]}}]),
    (TREE, [{"v": 1, "kids": [{"v": 2, "kids": []}]}], [{"v": 1, "kids": [{"kids": []}]}, {}]),
    (True, [1, None], []),
    (False, [], [1, None]),
]


def test_every_keyword(spark):
    rows = [(i, json.dumps(x), ok) for i, (_, good, bad) in enumerate(CASES) for ok, values in ((True, good), (False, bad)) for x in values]
    frame = spark.createDataFrame(rows, "i int, text string, ok boolean")
    wrong = []
    for start in range(0, len(CASES), 12):  # one expression of a dozen schemas at a time
        verdict = F.lit(None).cast("boolean")
        for i in range(start, min(start + 12, len(CASES))):
            verdict = F.when(F.col("i") == i, JsonSchema(CASES[i][0], {"https://x.example/tree": TREE}).check(F.col("text"))).otherwise(verdict)
        wrong += frame.where(F.col("i").between(start, start + 11)).withColumn("found", verdict).where("NOT (found <=> ok)").collect()
    assert not wrong, [(CASES[r.i][0], r.text, r.ok, r.found) for r in wrong]


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(None,), ("",), ("{bad",), ('{"a": 1, "a": 2}',), ("[1] x",), ("1], [2",), ("1, 2",), ("1}",)], "text string")
    assert [r[0] for r in rows.select(JsonSchema(True).check(F.col("text"))).collect()] == [False] * 8


@pytest.mark.parametrize("schema", [{"unevaluatedProperties": False}, {"$ref": "elsewhere"}, {"$ref": "#nowhere"}])
def test_what_is_refused(spark, schema):
    with pytest.raises(ValueError):
        JsonSchema(schema).check(F.lit("1"))
