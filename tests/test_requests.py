import json

from pyspark.sql import functions as F

from pagelake import settings
from pagelake.functions.text import json_string_bytes, utf16_length
from pagelake.operators import requests as req


def test_modes(spark):
    rows = spark.createDataFrame([(None,), ("strict",), ("COERCE",), (" strict﻿",), ("",), ("sanitize",)], "validation_mode STRING")
    found = req.request_options(rows.withColumn("content_format", F.lit("HTML"))).collect()
    assert [row.validation_mode for row in found] == ["coerce", "strict", "coerce", "strict", "coerce", "sanitize"]
    assert [row.status for row in found] == [200] * 5 + [400]
    assert found[5].error == settings.MODE_INVALID and found[0].content_format == "html"


def test_first_failing_rule_wins_and_split(spark):
    rows = spark.createDataFrame([(None, "week"), ("q", "week"), ("q", ""), ("q", None), ("q", "day")], "query STRING, time_range STRING")
    checked = req.validate_requests(rows, "search")
    assert [row.error for row in checked.collect()] == [settings.QUERY_REQUIRED, settings.TIME_RANGE_INVALID, None, None, None]
    good, bad = req.split_valid(checked)
    assert (good.count(), bad.count()) == (3, 2)


def test_text_sizes_match_python(spark):
    texts = ["", "plain", 'q"\\', "tab\tnl\n\r\b\f", "\x01\x7f", "é日", "😀a😀", "mix   \"é\" 😀\n"]
    rows = spark.createDataFrame([(text,) for text in texts], "t STRING").select(json_string_bytes(F.col("t")), utf16_length(F.col("t")))
    assert [tuple(row) for row in rows.collect()] == [(len(json.dumps(t)) - 2, len(t.encode("utf-16-le")) // 2) for t in texts]


def test_guard_order_and_exact_limits(spark):
    body = {"content": "", "json_schema": {"type": "object"}, "content_format": "txt", "source_url": "u\"é", "prompt": "p"}
    schema_bytes = len(json.dumps(body["json_schema"]))

    def guard(content, max_length, max_body):
        rows = spark.createDataFrame([(content, "u\"é", "p")], "content STRING, url STRING, prompt STRING")
        row = req.guard_content(rows, max_length, max_body, schema_bytes).first()
        return row.status, row.error

    content = "é" * 40 + "\n"
    exact = len(json.dumps({**body, "content": content}))
    assert guard(content, 100, exact) == (200, None)
    assert guard(content, 100, exact - 1) == (413, settings.BODY_TOO_LARGE.format(limit=exact - 1))
    assert guard(content, 40, 10) == (413, settings.CONTENT_TOO_LONG.format(limit=40))
    assert guard(" 　\n", 0, 0) == (400, settings.CONTENT_EMPTY)
    assert guard(None, 9, 9)[0] == 400
    assert guard("﻿", 9, 9999) == (400, settings.SIDECAR_EMPTY)
    assert guard("😀" * 4, 5, 9999) == (413, settings.SIDECAR_TOO_LONG.format(limit=5))


def test_clamps_keep_missing_limits(spark):
    rows = spark.createDataFrame([(None, None, None, "a, b,", None), (0, 500, 10**9, "", "de")], "pageno INT, max_results INT, max_content_length LONG, engines STRING, language STRING")
    first, second = req.normalise_requests(rows).collect()
    assert tuple(first) == (1, 20, None, ["a", " b", ""], "en")
    assert tuple(second) == (1, 100, 1024 * 1024, None, "de")
