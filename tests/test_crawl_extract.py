import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake import settings
from pagelake.operators import cache as cache_ops
from pagelake.operators import crawl as crawl_ops
from pagelake.operators import extract as ops
from pagelake.operators import fetch as fetch_ops

SITE = "https://s.org"
NOW = datetime.datetime(2024, 5, 1, 12)


def site(spark):
    pages = {
        "/": '<title>Home</title><a href="/a">Alpha docs</a><a href="/gone">docs gone</a><a href="/b">DOCS b</a><a href="/">docs home</a><a href="/c">other</a>',
        "/a": "<p>Alpha 5 points</p>",
        "/b": "<p>Beta</p><a href='/x'>x</a><a href='/x'>docs</a>",
        "/c": "<p>Alpha 5 points</p>",
        "/blank": "<script>x</script> ",
        "/long": "<p>" + "w" * 700 + "</p><a href='/a'>A</a>",
        "/bad": '<a href="http://[bad">x</a>',
    }
    return spark.createDataFrame([(i, SITE + path, html) for i, (path, html) in enumerate(pages.items())], "page_id LONG, url STRING, html STRING")


def seeds(spark, *rows):
    return spark.createDataFrame([(i, SITE + path, filters) for i, (path, filters) in enumerate(rows)], "seed_id LONG, url STRING, filters ARRAY<STRING>")


def test_crawl_limit_comes_before_the_fetch(spark):
    crawled = crawl_ops.crawl(seeds(spark, ("/", ["docs"]), ("/", None), ("/nowhere", None), ("/b", ["docs"]), ("/bad", [])), site(spark), 3, 10)
    summary = {r.seed_id: r for r in crawled.summary.collect()}
    subpages = {}
    for row in crawled.subpages.orderBy("seed_id", "pos").collect():
        subpages.setdefault(row.seed_id, []).append((row.url.removeprefix(SITE), row.anchor_text))
    # The missing page is chosen, lost, and no fourth link takes its place.
    assert subpages[0] == [("/a", "Alpha docs"), ("/b", "DOCS b")]
    assert (summary[0].total_subpages_found, summary[0].subpages_returned) == (4, 2)
    assert (summary[1].total_subpages_found, summary[1].filters_applied) == (5, None)
    assert summary[2].error == settings.PAGE_NOT_FOUND and summary[2].total_subpages_found is None
    # The url was first seen under another anchor.
    assert (summary[3].total_subpages_found, summary[3].subpages_returned) == (0, 0) and 3 not in subpages
    assert summary[4].error and crawled.main.where("seed_id = 4").first().content is None
    cut = crawled.subpages.where("seed_id = 0 AND pos = 0").first()
    assert cut.content == "Alpha 5 po" + settings.TRUNCATED_SUFFIX and cut.content_length == len(cut.content)
    reports = {r.seed_id: r.report for r in crawl_ops.render_crawl(crawled, 10).collect()}
    assert reports[0].startswith(f"Crawled: {SITE}/\nMain page content length: ")
    assert "Filters applied: docs\n" in reports[0] and "\n1. Alpha docs\n   URL: " in reports[0] and "\n2. DOCS b\n" in reports[0]
    assert "Filters applied" not in reports[1] and "SUBPAGES:" not in reports[3]
    assert reports[2] == "Crawl error: " + settings.PAGE_NOT_FOUND


def test_crawl_limits_per_seed(spark):
    own = seeds(spark, ("/", None), ("/", None)).selectExpr("*", "CAST(seed_id + 1 AS INT) AS subpage_limit", "IF(seed_id = 0, 3, NULL) AS max_content_length")
    found = crawl_ops.crawl(own, site(spark)).subpages.orderBy("seed_id", "pos").collect()
    assert [(r.seed_id, r.pos, r.content[:8]) for r in found] == [(0, 0, "Alp...\n["), (1, 0, "Alpha 5 ")]
    assert "max_content_length" not in found[0].asDict()


def test_flat_links(spark):
    links = fetch_ops.page_links(fetch_ops.parse_pages(site(spark)))
    home = links.where(F.col("page_url") == SITE + "/")
    assert [r.pos for r in crawl_ops.filter_links(home, ["DOCS"]).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert crawl_ops.filter_links(home, []).count() == crawl_ops.filter_links(home, None).count() == 5
    assert crawl_ops.filter_links(links.where(F.col("page_url") == SITE + "/b"), ["docs"]).count() == 0
    assert crawl_ops.select_subpages(links, 2).where(F.col("page_url") == SITE + "/").count() == 2


def test_fetch_rows_and_reports(spark):
    rows = [(1, SITE + "/a"), (2, SITE + "/none"), (3, SITE + "/long"), (4, SITE + "/bad"), (5, SITE + "/a")]
    requests = spark.createDataFrame(rows, "request_id LONG, url STRING")
    found = {r.request_id: r for r in fetch_ops.render_fetch(fetch_ops.fetch(requests, site(spark), 100)).collect()}
    assert len(found) == 5 and found[1].content == found[5].content == "Alpha 5 points"
    assert found[2].error == settings.PAGE_NOT_FOUND and found[2].report == "Fetch error: page not found"
    assert found[4].error and found[4].status_code is None
    section = settings.LINKS_MARKER + f"\nA: {SITE}/a"
    assert found[3].content == "w" * 100 + settings.TRUNCATED_SUFFIX + section
    assert found[3].full_length == 700 + 1 + len(section), found[3].full_length
    per_row = fetch_ops.fetch(requests.withColumn("n", F.lit(100)), site(spark), F.col("n"))
    assert {(r.request_id, r.content) for r in per_row.collect()} == {(i, r.content) for i, r in found.items()}


SCHEMA = {
    "type": "object",
    "properties": {"name": {"type": "string"}, "points": {"type": "integer"}},
    "required": ["name"],
}
RULES = {"name": ("^([A-Z][a-z]+)", 1), "points": ("([0-9]+ points)", 1)}


def run(spark, cache=None, schema=SCHEMA, paths=("/a", "/c", "/b", "/blank", "/none", "/a", "/long"), **options):
    requests = spark.createDataFrame(
        [(i, SITE + p) for i, p in enumerate(paths)] + [(99, None)], "request_id LONG, url STRING"
    )
    cache = cache_ops.load_cache(spark, None) if cache is None else cache
    return ops.extract(requests, site(spark), schema, ops.rule_extractor(RULES), cache, F.lit(NOW), **options)


def test_extract_statuses_and_reuse(spark):
    first = run(spark)
    rows = {r.request_id: r for r in first.results.collect()}
    assert json.loads(rows[0].data) == {"name": "Alpha", "points": 5} and rows[1].data == rows[5].data == rows[0].data
    assert json.loads(rows[2].data) == {"name": "Betaxdocs", "points": None}
    assert (rows[3].status, rows[3].error) == (400, settings.CONTENT_EMPTY)
    assert (rows[4].status, rows[4].stage, rows[4].error) == (200, "fetch", "Fetch error: page not found")
    assert (rows[6].status, rows[6].error) == (502, "extraction failed: $.name: expected string")
    assert (rows[99].status, rows[99].error) == (400, "Error: URL is required")
    # Equal text at two urls is one cache entry; failures are not stored.
    entries = first.new_entries.collect()
    assert len(entries) == 2 and all(e.expires_at - e.created_at == datetime.timedelta(days=1) for e in entries)
    second = {r.request_id: r for r in run(spark, first.new_entries).results.collect()}
    assert second[0].cached and second[1].cached and not second[6].cached and second[0].data == rows[0].data
    # Another mode, prompt or schema is another key.
    assert not any(r.cached for r in run(spark, first.new_entries, mode="strict").results.collect())
    strict = run(spark, mode="strict").results.where("request_id = 0").first()
    assert (strict.status, strict.error) == (502, "extraction failed: $.points: expected integer")
    report = {(r.level, r.status, r.cached): r.requests for r in ops.extraction_report(first.results).collect()}
    assert report[(3, None, None)] == 8 and report[(1, 502, None)] == 1


def test_modes_and_prompts_per_request(spark):
    rows = [(1, "/a", None, "strict"), (2, "/a", None, None), (3, "/a", "p", " COERCE"), (4, "/a", None, "loose"), (5, "/blank", None, "loose")]
    requests = spark.createDataFrame([(i, SITE + u, p, m) for i, u, p, m in rows], "request_id LONG, url STRING, prompt STRING, validation_mode STRING")

    def echo(pages):
        return pages.withColumn("record", F.to_json(F.struct(F.coalesce("prompt", F.lit("none")).alias("name"), F.lit("7 kg").alias("points"))))

    outcome = ops.extract(requests, site(spark), SCHEMA, echo, cache_ops.load_cache(spark, None), F.lit(NOW))
    found = {r.request_id: r for r in outcome.results.collect()}
    assert [found[i].status for i in range(1, 6)] == [502, 200, 200, 400, 400]
    assert (json.loads(found[2].data)["name"], json.loads(found[3].data)["name"]) == ("none", "p")
    assert [found[i].validation_mode for i in range(1, 6)] == [None, "coerce", "coerce", None, None]
    assert (found[4].error, found[5].error) == (settings.MODE_INVALID, settings.CONTENT_EMPTY)
    assert outcome.new_entries.count() == 2
    small = ops.extract(requests, site(spark), SCHEMA, echo, cache_ops.load_cache(spark, None), F.lit(NOW), max_length=5)
    assert small.results.where("request_id = 2").first().status == 413


@F.pandas_udf(T.StringType())
def shout(content: pd.Series) -> pd.Series:
    return '{"name":"' + content.str.upper().str.slice(0, 5) + '","points":null}'


def test_own_extractor_with_a_pandas_udf(spark):
    requests = spark.createDataFrame([(1, SITE + "/a")], "request_id LONG, url STRING")
    result = ops.extract(
        requests, site(spark), SCHEMA, lambda pages: pages.withColumn("record", shout("content")), cache_ops.load_cache(spark, None), F.lit(NOW)
    )
    assert json.loads(result.results.first().data) == {"name": "ALPHA", "points": None}


def test_hits_do_not_need_a_valid_schema(spark):
    bad = {**SCHEMA, "additionalProperties": True}
    refused = run(spark, schema=bad)
    row = refused.results.where("request_id = 0").first()
    assert row.status == 400 and "additionalProperties" in row.error and refused.new_entries.count() == 0
    key = spark.createDataFrame([("Alpha 5 points",)], "c STRING").select(ops.extraction_key(F.col("c"), bad)).first()[0]
    cached = spark.createDataFrame([(key, '{"old":1}', NOW, NOW + datetime.timedelta(hours=1))], cache_ops.CACHE_SCHEMA)
    hit = run(spark, cached, bad).results.where("request_id = 0").first()
    assert (hit.status, hit.cached, hit.data) == (200, True, '{"old":1}')


def test_crawl_extract(spark):
    crawled = crawl_ops.crawl(seeds(spark, ("/", None)), site(spark), 10)
    results = ops.crawl_extract(crawled.subpages, site(spark), SCHEMA, ops.rule_extractor(RULES), cache_ops.load_cache(spark, None), F.lit(NOW)).results
    assert {r.url.removeprefix(SITE): r.status for r in results.collect()} == {"/a": 200, "/b": 200, "/": 200, "/c": 200}


def test_secrets_are_scrubbed_from_errors(spark):
    schema = {"type": "object", "properties": {"secretkey": {"type": "integer"}}, "required": ["secretkey"]}
    requests = spark.createDataFrame([(0, SITE + "/a")], "request_id LONG, url STRING")
    result = ops.extract(
        requests, site(spark), schema, ops.rule_extractor({"secretkey": ("(Alpha)", 1)}), cache_ops.load_cache(spark, None), F.lit(NOW), secrets=("secretkey", "abc")
    )
    assert result.results.first().error == "extraction failed: $.[REDACTED]: expected integer"


@pytest.mark.parametrize("part, other", [("content", "b"), ("prompt", "p"), ("model", "m2"), ("mode", "strict"), ("schema", {"type": "array"})])
def test_key_changes_with_every_part(spark, part, other):
    def key(**changes):
        parts = {"content": "hello", "schema": SCHEMA, "mode": "coerce", "model": "m1", "prompt": "", **changes}
        content = F.lit(parts.pop("content"))
        return spark.range(1).select(ops.extraction_key(content, **parts)).first()[0]

    shuffled = json.loads(json.dumps(SCHEMA, sort_keys=True))
    assert key() == key(schema=shuffled) == key(prompt=None) != key(**{part: other})


def page_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id LONG, url STRING, html STRING")


def test_one_page_per_url(spark):
    pages = page_rows(spark, (2, "http://x/", "<p>two</p>"), (1, "http://x/", "<p>one</p>"), (1, "http://x/", "<p>one</p>"), (3, "http://y/", "<a href='/'>x</a>"))
    asked = spark.createDataFrame([(1, "http://x/"), (2, "http://y/"), (3, None)], "request_id INT, url STRING")
    found = fetch_ops.fetch(asked, pages).orderBy("request_id").collect()
    assert [(r.request_id, r.status_code) for r in found] == [(1, 200), (2, 200), (3, None)] and found[0].content.startswith("one")


SIZED = {"type": "object", "properties": {"size": {"type": "integer"}}, "required": ["size"]}
NAMED = {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}


def test_schema_and_content_of_each_request(spark):
    pages = page_rows(spark, (1, "http://x/", "<p>size 5 name Bo</p>"))
    rows = [
        (1, "http://x/", json.dumps(SIZED), None, None, None),
        (2, "http://x/", json.dumps(NAMED), None, None, None),
        (3, None, json.dumps(SIZED), "size 9", "markdown", '{"a": 1}'),
        (4, "http://x/", "{not json", None, None, None),
        (5, "http://x/", None, None, None, None),
        (6, "http://x/", '{"type": ["null", {}]}', None, None, None),
        (7, "http://x/", json.dumps(SIZED), "  ", None, None),
        (8, "http://x/", json.dumps(SIZED), "size 1", "pdf", None),
        (9, "http://x/", json.dumps(SIZED), "size 1", None, "{cut"),
        (10, None, json.dumps(SIZED), None, None, None),
        (11, "http://gone/", json.dumps(SIZED), None, None, None),
    ]
    asked = spark.createDataFrame(rows, "request_id INT, url STRING, json_schema STRING, content STRING, content_format STRING, extraction_context STRING")

    def run(df):
        record = F.when(F.col("json_schema").contains("size"), F.to_json(F.struct(F.regexp_extract("content", "size ([0-9]+)", 1).cast("int").alias("size"))))
        return df.withColumn("record", record.otherwise(F.to_json(F.struct(F.regexp_extract("content", "name (\\w+)", 1).alias("name")))))

    empty = spark.createDataFrame([], cache_ops.CACHE_SCHEMA)
    out = ops.extract(asked, pages, None, run, empty, F.lit("2024-01-01").cast("timestamp"))
    got = {r.request_id: r for r in out.results.collect()}
    assert len(got) == len(rows) and "content" not in out.results.columns
    assert [got[k].data for k in (1, 2, 3)] == ['{"size":5}', '{"name":"Bo"}', '{"size":9}']
    assert [got[k].status for k in range(4, 12)] == [400, 400, 400, 400, 400, 400, 400, 200]
    assert got[11].stage == "fetch" and out.new_entries.count() == 3


def test_token_cap(spark):
    """The loosest cap of one key holds, whatever the order of requests; caps that are no numbers are none."""
    pages = page_rows(spark, (1, "http://x/", "<p>" + "a" * 100 + "</p>"))
    rows = [(1, "p", 3.0), (2, "p", 5.9), (3, "q", None), (4, "q", 2.0), (5, "r", float("nan")), (6, "s", float("inf")), (7, "t", -4.0), (8, "v", 10.0)]
    asked = spark.createDataFrame(rows, "request_id INT, prompt STRING, max_input_tokens DOUBLE").withColumn("url", F.lit("http://x/"))
    run = lambda df: df.withColumn("record", F.to_json(F.struct(F.length("content").alias("size"))))
    empty = spark.createDataFrame([], cache_ops.CACHE_SCHEMA)
    for some in (asked, asked.orderBy(F.col("request_id").desc()), asked.withColumn("max_input_tokens", F.col("max_input_tokens").cast("string"))):
        out = ops.extract(some, pages, SIZED, run, empty, F.lit("2024-01-01").cast("timestamp"))
        sizes = {r.request_id: r.data for r in out.results.collect()}
        assert sizes == {1: '{"size":23}', 2: '{"size":23}', 3: '{"size":100}', 4: '{"size":100}', 5: '{"size":100}', 6: '{"size":100}', 7: '{"size":0}', 8: '{"size":40}'}


def test_hits_alone_write_no_text(spark, tmp_path, monkeypatch):
    pages = page_rows(spark, (1, "http://x/", "<p>size 5</p>"))
    asked = spark.createDataFrame([(1, "http://x/")], "request_id INT, url STRING")
    run = lambda df: df.withColumn("record", F.lit('{"size": 5}'))
    at = F.lit("2024-01-01").cast("timestamp")
    written = []
    keep = ops.materialize
    monkeypatch.setattr(ops, "materialize", lambda df, name="table": written.append((name, df.columns)) or keep(df, name))
    first = ops.extract(asked, pages, SIZED, run, spark.createDataFrame([], cache_ops.CACHE_SCHEMA), at)
    entries = keep(first.new_entries)
    assert ("contents" in dict(written)) and entries.count() == 1
    written.clear()
    again = ops.extract(asked, pages, SIZED, run, entries, at).results.collect()
    assert again[0].cached and not any("content" in columns for name, columns in written)
