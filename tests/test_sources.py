import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from pagelake.sources import engines, responses, sinks

SCHEMA = "id INT, body BINARY, headers MAP<STRING,STRING>"


def decode(spark, body, headers=None):
    rows = spark.createDataFrame([(1, bytearray(body), headers or {})], SCHEMA)
    return responses.decode_responses(rows).first()


@pytest.mark.parametrize(
    "body, headers, text",
    [
        (gzip.compress(b"seven seas"), {}, "seven seas"),
        (gzip.compress(b"<p>packed</p>"), {"Content-Encoding": "gzip"}, "<p>packed</p>"),
        (b"<p>as it is</p>", {}, "<p>as it is</p>"),
        (gzip.compress("Größe".encode("latin-1")), {"Content-Encoding": "gzip", "Content-Type": "text/plain; charset=iso-8859-1"}, "Größe"),
        (b"no charset", {"Content-Type": "text/plain"}, "no charset"),
        (gzip.compress(b"x"), {"content-encoding": " X-GZIP , br"}, "x"),
        (zlib.compress(b"deflated"), {"Content-Encoding": "deflate"}, "deflated"),
        ("日本".encode("shift_jis"), {"content-type": "text/html; Charset='shift_jis'; q=1"}, "日本"),
        (b"", {}, ""),
    ],
)
def test_decode(spark, body, headers, text):
    row = decode(spark, body, headers)
    assert (row.text, row.error) == (text, None)


@pytest.mark.parametrize(
    "body, headers",
    [
        (b"\xff\xfe", {}),
        (b"not gzip", {"Content-Encoding": "gzip"}),
        (gzip.compress(b"hello world")[:-4], {}),
        (b"x", {"Content-Encoding": "deflate"}),
        (b"x", {"Content-Type": "text/html; charset=nosuch"}),
    ],
)
def test_bad_bodies_become_error_rows(spark, body, headers):
    row = decode(spark, body, headers)
    assert row.text is None and row.error


ENVELOPE = {
    "query": "tide tables",
    "number_of_results": 3,
    "results": [
        {
            "url": "https://sea.example.net/tides?d=1", "title": "Tides", "content": "High water at noon", "engine": "harbour",
            "parsed_url": ["https", "sea.example.net", "/tides"], "template": "plain", "engines": ["harbour", "coast"], "positions": [2, 5], "score": 0.25,
        }
    ],
    "answers": [{"answer": "12:04", "type": "time", "engine": "clock"}],
    "corrections": [{"correction": "tide tables", "original": "tied tables"}],
    "infoboxes": [{"infobox": "Tide", "content": "Rise and fall of the sea", "engine": "lexicon"}],
    "suggestions": [],
    "unresponsive_engines": ["buoy"],
}


def parts_of(good):
    hit = responses.explode_envelope(good, "results").first()
    assert (hit.query, hit.position, hit.engine, hit.positions, hit.score) == ("tide tables", 1, "harbour", [2, 5], 0.25)
    assert responses.explode_envelope(good, "answers").first().answer == "12:04"
    assert responses.explode_envelope(good, "corrections").first().original == "tied tables"
    assert responses.explode_envelope(good, "infoboxes").first().infobox == "Tide"
    assert responses.explode_envelope(good, "suggestions").first().value is None
    assert responses.explode_envelope(good, "unresponsive_engines").first().value == "buoy"


def test_indented_responses_are_one_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ENVELOPE, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"error": "gone"}, indent=4))
    (tmp_path / "c.json").write_text('{"query":\n "cut')
    rows = responses.read_search_responses(spark, str(tmp_path), one_per_file=True)
    assert sorted(str(row.error) for row in rows.collect()) == ["None", "gone", "malformed JSON"]
    parts_of(rows.where("error IS NULL"))


def test_indented_responses_in_bundles(spark, tmp_path):
    """Files do not grow with the responses, and each response comes back by its name, repeated and missing ones too."""
    body = json.dumps(ENVELOPE, indent=2)
    odd = [("odd", json.dumps({"error": "a\x1eb"}, indent=4)), ("odd", json.dumps({"error": "a\x1eb"})), ("cut", '{"query":\n "cut'), (None, None)]
    stored = spark.createDataFrame([*((str(k), body) for k in range(200)), *odd], "name STRING, value STRING").coalesce(2)
    responses.write_response_bundles(stored, str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) == 2
    rows = responses.read_response_bundles(spark, str(tmp_path / "b")).cache()
    found = {(r.name, r.error) for r in rows.where("query IS NULL").collect()}
    assert rows.count() == 204 and found == {("odd", "a\x1eb"), ("cut", "malformed JSON"), (None, "malformed JSON")}
    assert {r.name for r in rows.where("error IS NULL").collect()} == {str(k) for k in range(200)}
    parts_of(rows.where("name = '7'"))


def test_read_search_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join([json.dumps(ENVELOPE), '{"query": "cut', '{"error": "HTTP Error 500"}']))
    rows = responses.read_search_responses(spark, str(tmp_path)).cache()
    assert [row.error for row in rows.collect()] == [None, "malformed JSON", "HTTP Error 500"]
    good = rows.where("error IS NULL")
    parts_of(good)


def test_engine_catalog(spark):
    catalog = engines.engine_catalog(spark).cache()
    assert catalog.count() == 14 and catalog.where("enabled").count() == 13
    assert {row.name for row in engines.engines_by_category(catalog).where("category = 'it'").collect()} == {"github", "stackexchange"}
    assert catalog.where("name = 'yacy'").first().base_urls[0] == "https://yacy.searchlab.eu"
    assert engines.engine_listing(catalog).where("name = 'bing'").first().line == "bing: No description"


def test_write_results(spark, tmp_path):
    rows = spark.createDataFrame([("é", None)], "report STRING, other INT")
    sinks.write_results(rows, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"report":"é","other":null}'
    sinks.write_results(rows, str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).first().value == "é"
    with pytest.raises(ValueError):
        sinks.write_results(rows, str(tmp_path / "x"), "xml")


def test_header_lookup(spark):
    rows = spark.createDataFrame([({"X": ""},), ({"x": "b"},), ({"X": "a", "x": "b"},)], "headers MAP<STRING,STRING>")
    assert [row[0] for row in rows.select(responses.header("X")).collect()] == [None, "b", "a"]
    assert rows.select(F.size("headers")).count() == 3
