"""Schemas as rows give the verdicts, messages and values of schemas as expressions."""

import json

import pytest
from pyspark.sql import functions as F

from pagelake.operators.records import validate_records
from pagelake.operators.schema import compile_schema
from pagelake.operators.schema_table import check_records, compile_schemas, printed


def obj(required=None, **members):
    return {"type": "object", "properties": members, "required": list(members) if required is None else required}


TEXT, WHOLE, REAL, FLAG = ({"type": kind} for kind in ("string", "integer", "number", "boolean"))
MAYBE = {"type": ["integer", "null"]}
SCHEMAS = [
    obj(title=TEXT, price=REAL, amount=WHOLE, open=FLAG),
    obj([], title=TEXT, price=MAYBE),
    obj(shop=obj(name=TEXT, tags={"type": "array", "items": {"type": ["string", "null"]}}), rows={"type": ["array", "null"], "items": obj(q=REAL, r=MAYBE)}),
    {"type": "array", "items": {"type": "array", "items": WHOLE}},
    {"type": ["string", "null"]},
    WHOLE,
    obj(),
    obj(**{'say "so"': TEXT, "it's": WHOLE, "a?b": FLAG, "": TEXT, "é.x": REAL}),
    obj(deep=obj(deep=obj(deep=obj(deep={"type": "array", "items": obj(leaf=REAL)})))),
]
RECORDS = [
    '{"title": "Chair", "price": 12.5, "amount": 3, "open": true}', '{"title": "T", "price": "12.50 EUR", "amount": "7 left", "open": false}',
    '{"title": null, "price": null, "amount": null, "open": null}', '{"title": 1, "price": true, "amount": 2.5, "open": "true", "zz": 1, "aa": {}}',
    '{"price": 1e3, "amount": 9223372036854775807, "open": true, "title": "\\u00e9 \\"q\\" \\n"}', '{"title": "x", "price": "1,234", "amount": 1e30, "open": true}',
    '{"title": "x"}', '{"title": null, "price": null}', '{"price": 5}', "{}", "[]", "null", "7", '"text"', '"12 apples"', "[[1, 2], [], [3]]", '[[1, "x"], 4, [true]]',
    '{"shop": {"name": "S", "tags": ["a", null, "b"]}, "rows": [{"q": 1, "r": null}, {"q": "2 kg", "r": "3"}]}', '{"shop": {"name": "S", "tags": []}, "rows": null}',
    '{"shop": {"tags": [1], "more": 2}, "rows": [{"q": null, "r": 2}, 5, {"q": 1, "s": 1}]}', '{"shop": [], "rows": {}}',
    '{"say \\"so\\"": "x", "it\'s": 4, "a?b": true, "": "e", "é.x": 2}', '{"say \\"so\\"": 1, "it\'s": "4.0", "a?b": null, "": "e"}',
    '{"deep": {"deep": {"deep": {"deep": [{"leaf": 1.0E10}, {"leaf": "0.001"}, {}]}}}}', '{"deep": {"deep": {"deep": {"deep": [{"leaf": 123456789.125}]}}}}',
    "{cut", None, '{"amount": 12, "amount": 13}', '{"title": "x", "price": 0.1, "amount": "", "open": true}',
]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, json.dumps(s), m, r) for k, s in enumerate(SCHEMAS) for m in ("strict", "coerce") for r in RECORDS]
    return spark.createDataFrame(made, "number INT, json_schema STRING, mode STRING, record STRING").cache()


def test_same_as_expressions(spark, rows):
    schemas = compile_schemas(rows.select("json_schema").distinct()).cache()
    assert schemas.where("problem IS NOT NULL").count() == 0
    depth = schemas.agg(F.max("depth")).first()[0]
    assert depth == 6
    checked = check_records(rows.join(schemas, "json_schema"), "record", "rules", "mode", depth)
    mine = {(r.number, r.mode, r.record): (r.data, r.valid, r.errors) for r in checked.collect()}
    assert len(mine) == rows.count() and sum(v[1] for v in mine.values()) >= 30
    for number, schema in enumerate(SCHEMAS):
        for mode in ("strict", "coerce"):
            some = rows.where((F.col("number") == number) & (F.col("mode") == mode))
            theirs = validate_records(some, "record", compile_schema(schema), mode).withColumn("data", F.when(F.col("valid"), printed(F.col("data"))))
            for r in theirs.collect():
                assert mine[number, mode, r.record] == (r.data, r.valid, r.errors), (schema, mode, r.record)


def test_plan_does_not_grow_with_schemas(spark):
    """Ten schemas or five hundred: the same plan."""

    def plan_of(n):
        made = [(json.dumps(obj(**{f"f{k}": WHOLE})), "strict", f'{{"f{k}": {k}}}') for k in range(n)]
        df = spark.createDataFrame(made, "json_schema STRING, mode STRING, record STRING")
        checked = check_records(compile_schemas(df), "record", "rules", "mode", 1)
        assert checked.where("valid").count() == n
        return len(checked._jdf.queryExecution().optimizedPlan().toString())

    assert abs(plan_of(10) - plan_of(500)) < 50


def test_bad_schemas_are_rows(spark):
    bad = ['{"type": "map"}', "[1]", "{cut", '{"type": "object"}', None, "7", '{"type": ["null", {}]}', "[" * 100_000]
    df = spark.createDataFrame([(text,) for text in bad], "json_schema STRING")
    found = compile_schemas(df).collect()
    assert len(found) == len(bad) and all(r.problem and r.rules is None for r in found)
    assert compile_schemas(df.where("1 = 0")).collect() == []
