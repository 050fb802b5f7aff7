import json

import pytest
from pyspark.sql import functions as F

from pagelake.operators.records import validate_records
from pagelake.operators.schema import SchemaError, compile_schema, fields_schema, humanize


def obj(properties, required=None, **more):
    return {"type": "object", "properties": properties, "required": list(properties) if required is None else required, **more}


@pytest.mark.parametrize(
    "schema, message",
    [
        (obj({"a": {"type": "string"}}, nullable=True), "nullable"),
        (obj({"nullable": {"type": "string"}}), "nullable"),
        (obj({"a": {"type": "string"}}, additionalProperties=True), "additionalProperties: true"),
        (obj({"a": {"type": "string"}}, additionalProperties=None), "additionalProperties (at $)"),
        (obj({"a": {"type": "string", "$ref": "#/defs/x"}}), "$ref (at $.properties.a)"),
        (obj({"a": {"type": "string", "enum": ["x"]}}), "enum"),
        ({"type": "object"}, "requires properties"),
        (obj({"a": {"type": "array"}}), "requires items"),
        (obj({"a": {"type": ["string", "integer"]}}), "type arrays"),
        (obj({"a": {"type": ["null"]}}), "type arrays"),
        (obj({"a": {"type": "date"}}), "Unsupported JSON Schema type: date"),
        (obj({"a": {}}), "Missing or invalid type"),
        (obj({"a": "string"}), "Schema must be an object"),
        ([], "must be a JSON object"),
    ],
)
def test_refused_schemas(schema, message):
    with pytest.raises(SchemaError) as problem:
        compile_schema(schema)
    assert message in str(problem.value)


def test_compiled_types():
    field = compile_schema(
        obj(
            {"t": {"type": "string", "description": "Title"}, "n": {"type": ["number", "null"]}, "l": {"type": "array", "items": {"type": ["integer", "null"]}}},
            ["t", "l", "unknown"], additionalProperties=False,
        )
    )
    assert field.dataType.simpleString() == "struct<t:string,n:double,l:array<bigint>>"
    assert [child.nullable for child in field.dataType.fields] == [False, True, False]
    assert field.dataType["t"].metadata == {"description": "Title"} and field.dataType["l"].dataType.containsNull


def check(spark, schema, mode, *records):
    rows = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records)], "i INT, r STRING")
    checked = validate_records(rows, "r", compile_schema(schema), mode)
    data = F.to_json(F.struct("data"), {"ignoreNullFields": "false"})
    found = checked.select("i", "valid", "errors", data.alias("d")).orderBy("i").collect()
    return [json.loads(row.d)["data"] if row.valid else row.errors for row in found]


def test_optional_fields_may_be_null_but_not_absent(spark):
    schema = obj({"port": {"type": "string"}, "depth": {"type": "number"}, "note": {"type": "string"}}, ["port"])
    full, bare = {"port": "Kiel", "depth": 4.5, "note": "quiet"}, {"port": "Ystad", "depth": None, "note": None}
    found = check(spark, schema, "strict", full, bare, {"port": "Riga", "note": "x"}, {"depth": 1, "note": "y"})
    assert found == [full, bare, ["$.depth: missing"], ["$.port: missing"]]


def test_integers(spark):
    schema = obj({"n": {"type": "integer"}})
    values = ["518", "518 points", 518, "518.7", "1e3", "1,234", " 42 ", "abc", "+5", "", True, None, 7.0, 7.5, 1e300, [1]]
    bad = ["$.n: expected integer"]
    coerced = [518, 518, 518, bad, 1, 1, 42, bad, 5, 0, bad, bad, 7, bad, bad, bad]
    strict = [bad, bad, 518, bad, bad, bad, bad, bad, bad, bad, bad, bad, 7, bad, bad, bad]
    for mode, expected in (("coerce", coerced), ("strict", strict)):
        found = check(spark, schema, mode, *({"n": value} for value in values))
        assert found == [{"n": value} if isinstance(value, int) else value for value in expected]


def test_nullable_number_keeps_null(spark):
    schema = obj({"n": {"type": ["number", "null"]}})
    assert check(spark, schema, "coerce", {"n": None}, {"n": "-.5"}, {"n": True}) == [{"n": None}, {"n": -0.5}, ["$.n: expected number"]]


def test_nested_and_odd_names(spark):
    schema = obj(
        {
            "it's": {"type": "integer"},
            "a.b": obj({"x?\"'": obj({"y": {"type": "boolean"}})}),
            "l": {"type": "array", "items": obj({"q": {"type": "array", "items": {"type": "number"}}})},
        }
    )
    good = {"it's": 1, "a.b": {"x?\"'": {"y": False}}, "l": [{"q": [1, "2 kg"]}, {"q": []}]}
    bad = {"it's": 1, "a.b": {"x?\"'": {"y": "no"}, "z": 1}, "l": [{"q": [1, "kg"]}, 5, {}], "more": {}}
    found = check(spark, schema, "coerce", good, bad, "[]", "not json", '{"it\'s": null}')
    assert found[0] == {"it's": 1, "a.b": {"x?\"'": {"y": False}}, "l": [{"q": [1.0, 2.0]}, {"q": []}]}
    assert found[1] == [
        "$.a.b.x?\"'.y: expected boolean",
        "$.a.b.z: unexpected",
        "$.l[0].q[1]: expected number",
        "$.l[1]: expected object",
        "$.l[2].q: missing",
        "$.more: unexpected",
    ]
    assert found[2:] == [["$: expected object"], ["$: not valid JSON"], ["$.it's: expected integer", "$.a.b: missing", "$.l: missing"]]


def test_root_may_be_any_type(spark):
    assert check(spark, {"type": "array", "items": {"type": "string"}}, "strict", ["a"], {}) == [["a"], ["$: expected array"]]
    assert check(spark, {"type": ["integer", "null"]}, "strict", 4, "null") == [4, None]


def test_fields_schema():
    schema, prompt = fields_schema(" team_name ,, score-home ")
    assert prompt is None and schema["required"] == ["team_name", "score-home"]
    assert schema["properties"]["score-home"] == {"type": "string", "description": "Score Home"}
    schema, prompt = fields_schema({"a": None, "prompt": "p"})
    assert (list(schema["properties"]), prompt) == (["a"], "p")
    assert fields_schema({"a": "A", "prompt": "p"}, " q ")[1] == "q"
    for empty in (" , ", {"prompt": "x"}, {" ": "x"}):
        with pytest.raises(ValueError):
            fields_schema(empty)
    assert humanize(" HOME__team-NAME ") == "Home Team Name"
