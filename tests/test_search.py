import json
import math
import random
import re

from pyspark.sql import functions as F

from pagelake import settings
from pagelake.operators import search

VOCABULARY = "the cat sat on a mat dog café über".split()


def corpus(seed=5, size=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 25))) + rng.choice(["", ". ", "!\n", "  The"])) for i in range(size)]


def words(text):
    return [word for word in re.split(r"[^\w]+", text.lower()) if word]


def brute_matches(docs, query):
    phrases = [words(p) for p in re.findall(r'"([^"]*)"', query)]
    for doc_id, text in docs:
        tokens = words(text)
        has = lambda p: any(tokens[i : i + len(p)] == p for i in range(len(tokens) - len(p) + 1))
        if set(words(query)) <= set(tokens) and words(query) and all(map(has, phrases)):
            yield doc_id, tokens


def brute_scores(docs, query):
    n = len(docs)
    mean = sum(len(words(text)) for _, text in docs) / n
    df = {w: sum(w in words(text) for _, text in docs) for w in set(words(query))}
    for doc_id, tokens in brute_matches(docs, query):
        score = 0.0
        for w in df:
            tf = tokens.count(w)
            score += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
        yield doc_id, round(score, 6)


QUERIES = [(1, "the"), (2, "THE cat"), (3, '"the cat"'), (4, '"the the cat" mat'), (5, '"a mat" "dog café"'), (6, "Über"), (7, "none"), (8, '"cat cat"')]


def test_scores_against_brute_force(spark, monkeypatch):
    docs = corpus()
    frames = spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(QUERIES, "query_id LONG, query STRING")
    expected = {(q, d, s) for q, query in QUERIES for d, s in brute_scores(docs, query)}
    assert len(expected) > 40

    def found():
        return {(r.query_id, r.doc_id, round(r.score, 6)) for r in search.rank_bm25(*frames).collect()}

    assert found() == expected
    # More units than fit a broadcast take the other way to the same result.
    monkeypatch.setattr(search, "fits", lambda df: False)
    assert found() == expected


def hits(spark):
    rows = [("q", i, float(100 - i // 2), f"t{i}", f"u{i}", "c" * 400, "e") for i in range(30)]
    return spark.createDataFrame(rows, "query_id STRING, doc_id LONG, score DOUBLE, title STRING, url STRING, content STRING, engine STRING")


def test_paging(spark):
    def page(*args):
        return [(r.doc_id, r.rank) for r in search.page_results(hits(spark), *args).orderBy("rank").collect()]

    assert page(2, 10, 3) == [(10, 1), (11, 2), (12, 3)]
    assert page(3, 20, 20) == [] and page(1, 10, -4) == []
    assert page(0, 10, 100) == [(i, i + 1) for i in range(10)]
    assert [r.doc_id for r in search.page_results(hits(spark), F.lit(2), 10, F.lit(3)).orderBy("rank").collect()] == [10, 11, 12]


def test_merge(spark):
    rows = [
        ("q", "u", "bing", 3, "B", "b"), ("q", "u", "google", 1, "G", "g"), ("q", "u", "google", 7, "late", "x"), ("q", "v", "bing", 1, "V", "v"),
    ]
    merged = {r.url: r for r in search.merge_engines(spark.createDataFrame(rows, "query_id STRING, url STRING, engine STRING, position INT, title STRING, content STRING")).collect()}
    u = merged["u"]
    assert (u.title, u.engine, u.engines, u.positions) == ("G", "google", ["bing", "google"], [1, 3])
    assert abs(u.score - (1 / 61 + 1 / 63)) < 1e-9 and merged["v"].positions == [1]


def test_merge_moves_text_of_winners_only(spark):
    """Nulls are values, ties go to the least title, and neither the aggregation nor the first hit sorts rows to aggregate."""
    schema = "query_id STRING, url STRING, engine STRING, position INT, title STRING, content STRING"
    rows = [("q", None, "e", 1, "N", "n"), ("q", None, None, 1, "M", "m"), (None, "u", "e", 2, "b", "x"), (None, "u", "e", 2, "a", "z"), (None, "u", "e", 2, "a", "y")]
    table = spark.createDataFrame(rows, schema)
    merged = {(r.query_id, r.url): r for r in search.merge_engines(table).collect()}
    assert len(merged) == 2 and (merged[None, "u"].title, merged[None, "u"].content, merged[None, "u"].positions) == ("a", "y", [2])
    assert merged["q", None].title == "M" and merged["q", None].positions == [1, 1]
    assert search.merge_engines(table.where("1 = 0")).count() == 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored = hits(spark).withColumn("position", F.lit(1))
    assert "SortAggregate" not in plan(search.found_positions(stored)) and "content" not in plan(search.found_positions(stored)).split("HashAggregate")[1]
    first = plan(search.top_hit(stored))
    assert "SortAggregate" not in first and "WindowGroupLimit" in first


def render(spark, mode, rows, total):
    queries = spark.createDataFrame([("q", "cats", total)], "query_id STRING, query STRING, total LONG")
    schema = "query_id STRING, rank INT, title STRING, url STRING, content STRING, engine STRING"
    return search.render_results(queries, spark.createDataFrame(rows, schema), mode).first().report


def test_rendering(spark):
    rows = [("q", 2, None, "u2", "", None), ("q", 1, "T", "u1", "c" * 301, "e1")]
    assert render(spark, "pretty", rows, 42) == "\n".join(
        ["Query: cats", "Number of results: 2", "Search time: 42 results", "=" * 60, "\n1. T", "   URL: u1", "   Engine: e1"]
        + ["   Content: " + "c" * 300 + "...", "-" * 40, "\n2. N/A", "   URL: u2", "   Engine: N/A", "-" * 40]
    )
    assert render(spark, "simple", rows, 2) == "\n".join(
        ["Title: T", "URL: u1", "Content: " + "c" * 200 + "...", "-" * 50, "Title: N/A", "URL: u2", "Content: ", "-" * 50]
    )
    assert render(spark, "numbered", rows, 42) == (
        "Search results for 'cats' (showing 2 of 42 results):\n\n"
        f"1. T\n   URL: u1\n   Engine: e1\n   Content: {'c' * 301}\n\n2. N/A\n   URL: u2\n   Engine: N/A\n   Content: \n"
    )
    assert render(spark, "numbered", [], 0) == settings.NO_RESULTS


def test_counts_top_and_silent_engines(spark):
    queries = spark.createDataFrame([("q", "cats"), ("z", "none")], "query_id STRING, query STRING")
    counts = {r.query_id: r for r in search.result_counts(queries, hits(spark), 20).collect()}
    assert (counts["q"].total, counts["q"].shown, counts["q"].message) == (30, 20, None)
    assert (counts["z"].total, counts["z"].message) == (0, settings.NO_RESULTS)
    assert search.top_hit(hits(spark)).first().title == "t0"
    requested = spark.createDataFrame([("q", "e"), ("q", "f"), ("z", "e")], "query_id STRING, engine STRING")
    assert {tuple(r) for r in search.unresponsive_engines(requested, hits(spark)).collect()} == {("q", "f"), ("z", "e")}


def test_pages_far_beyond_the_hits_are_empty(spark):
    far = search.page_results(hits(spark), F.lit(2_000_000_000), None, F.lit(100))
    assert far.count() == 0
    assert search.page_results(hits(spark), 1, None, 100).count() == hits(spark).count()


def test_json_has_every_field_and_errors_stand_alone(spark):
    queries = spark.createDataFrame([(1, "q", 1, None, ["s"]), (2, "r", 0, "down", [])], "query_id INT, query STRING, total LONG, error STRING, suggestions ARRAY<STRING>")
    paged = spark.createDataFrame([(1, 1, "u", None, "c", "e", ["e", "f"], [1, 2], 0.5)], "query_id INT, rank INT, url STRING, title STRING, content STRING, engine STRING, engines ARRAY<STRING>, positions ARRAY<INT>, score DOUBLE")
    shown = {r.query_id: r.report for r in search.render_results(queries, paged, "json").collect()}
    body = json.loads(shown[1])
    assert body["results"] == [{"url": "u", "title": None, "content": "c", "engine": "e", "engines": ["e", "f"], "positions": [1, 2], "score": 0.5}]
    assert body["suggestions"] == ["s"] and shown[2] == "Error: down"
    assert search.render_results(queries.where("query_id = 2"), paged, "numbered").first().report == "Search error: down"
