"""Substring joins against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import containment, crawl, search


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [(k % 3, word(rng.randrange(0, 14))) for k in range(120)] + [(0, None), (1, ""), (2, "aaaa")]
    patterns = [(k % 4, word(rng.randrange(1, 6))) for k in range(60)] + [(1, ""), (2, None), (0, "abcabcabcabcabcabc"), (2, "aaa")]
    return texts, patterns


def test_contained(spark, cases):
    texts, patterns = cases
    df = spark.createDataFrame(texts, "k INT, text STRING"), spark.createDataFrame(patterns, "k INT, pattern STRING")
    found = {tuple(r) for r in containment.contained(*df, "text", "pattern", ["k"]).select("k", "text", "pattern").collect()}
    assert found == {(k, t, p) for k, t in texts for j, p in patterns if k == j and t is not None and p is not None and p in t}
    found = {tuple(r) for r in containment.contained(*df, "text", "pattern", []).select("text", "pattern").collect()}
    assert found == {(t, p) for _, t in texts for _, p in patterns if t is not None and p is not None and p in t}


@pytest.mark.parametrize("chars", [containment.AUTOMATON_CHARS, 40])
def test_found_in_texts(spark, cases, monkeypatch, chars):
    """Alike with one automaton and with several."""
    monkeypatch.setattr(containment, "AUTOMATON_CHARS", chars)
    texts, patterns = cases
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id INT, text STRING")
    found = sorted(tuple(r) for r in containment.found_in_texts(docs, spark.createDataFrame(patterns, "k INT, pattern STRING")).collect())
    assert found == sorted({(k, p) for k, (_, t) in enumerate(texts) for _, p in patterns if t is not None and p is not None and p in t})


def test_filter_table_plan_and_defaults(spark):
    links = spark.createDataFrame([("p", 0, "The Docs"), ("p", 1, "news"), ("q", 0, "News of x"), ("r", 0, None)], "page_url STRING, pos INT, anchor_text STRING")
    table = spark.createDataFrame([("p", "DOC"), ("p", "zzz"), ("r", "n")], "page_url STRING, filter STRING")
    rows = lambda df: sorted((r.page_url, r.pos) for r in df.collect())
    assert rows(crawl.filter_links_table(links, table, ["page_url"])) == [("p", 0), ("q", 0)]
    everywhere = crawl.filter_links_table(links, table.select("filter"))
    assert rows(everywhere) == [("p", 0), ("p", 1), ("q", 0)]
    assert rows(crawl.filter_links_table(links, table.where("1 = 0").select("filter"))) == rows(links)
    plan = everywhere._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_substring_phrases(spark):
    docs = spark.createDataFrame([(1, "A Bookshop here"), (2, "book shop"), (3, None), (4, "ook, THE book")], "doc_id LONG, text STRING")
    asked = spark.createDataFrame([(1, '"book"'), (2, '"OOK"  the'), (3, '"k sh"'), (4, 'book "book"'), (5, '"a" "b"'), (6, ""), (7, '""')], "query_id LONG, query STRING")
    found = sorted(tuple(r) for r in search.match_substrings(docs, asked).collect())
    assert found == [(1, 1), (1, 2), (1, 4), (2, 4), (3, 2), (4, 2), (4, 4), (5, 1)]
    whole = sorted(tuple(r) for r in search.match_documents(docs, asked.where("query_id = 1")).collect())
    assert whole == [(1, 2), (1, 4)]


def test_no_queries(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id LONG, text STRING")
    assert search.match_substrings(docs, spark.createDataFrame([], "query_id LONG, query STRING")).collect() == []
    assert search.match_substrings(docs.where("1 = 0").withColumn("text", F.col("text")), spark.createDataFrame([(1, '"x"')], "query_id LONG, query STRING")).collect() == []
