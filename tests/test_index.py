"""The index gives what the texts give; the first hits come without opening most of a frequent word's blocks."""

import pytest
from pyspark.sql import functions as F

from pagelake.operators import index as ops
from pagelake.operators import search

QUERIES = [(1, "the"), (2, "of the"), (3, '"of the"'), (4, "nosuchword the"), (5, 'und "der sch"'), (6, ""), (7, "a the of to"), (8, '"nosuch phrase"'), (9, "THE the")]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "the the THE"), (-5, "of the, of the")], "doc_id LONG, text STRING")
    return table.unionByName(odd).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id LONG, query STRING").cache()


@pytest.fixture(scope="module")
def whole(spark, docs, tmp_path_factory):
    index = ops.SearchIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), 16)
    index.append(docs)
    return index


def ranked(hits):
    return sorted((r.query_id, r.doc_id, r.score) for r in hits.collect())


def test_rank_from_the_index(docs, asked, whole):
    found = ops.rank_index(whole, asked)
    expected = ranked(search.rank_bm25(docs, asked))
    assert ranked(found) == expected and len({q for q, _, _ in expected}) >= 6


def test_appended_and_merged(spark, docs, asked, tmp_path):
    """Segments count together, a merge changes nothing, and only folders of asked words are opened."""
    index = ops.SearchIndex(spark, str(tmp_path / "i"), 16)
    parts = [docs.where("doc_id % 4 = 1"), docs.where("doc_id % 4 IN (2, 3)"), docs.where("doc_id % 4 <= 0")]
    so_far = None
    for part in parts:
        index.append(part)
        so_far = part if so_far is None else so_far.unionByName(part)
        assert ranked(ops.rank_index(index, asked)) == ranked(search.rank_bm25(so_far, asked))
    files = {r[0] for r in index.postings(None).select(F.input_file_name()).distinct().collect()}
    index.merge()
    assert ranked(ops.rank_index(index, asked)) == ranked(search.rank_bm25(so_far, asked))
    assert index.postings(None).select("segment").distinct().count() == 1 and len(files) > 16
    one = index.postings(spark.createDataFrame([("the",)], "term STRING"))
    assert len({r[0] for r in one.select(F.input_file_name()).distinct().collect()}) == 1
    assert index.postings(spark.createDataFrame([], "term STRING")).count() == 0


def test_blocks_hold_every_posting(docs, whole):
    tokens = docs.select("doc_id", F.posexplode(search.words(F.col("text"))).alias("at", "term"))
    rows = whole.postings(None).select("term", "block", "span", "front", "docs", F.posexplode("offsets").alias("k", "offset"), "counts", "lengths", "places")
    flat = rows.select("term", (F.col("block") * F.col("span") + F.col("offset")).alias("doc_id"), F.explode(F.get("places", F.col("k"))).alias("at"))
    assert flat.count() == tokens.count() and flat.exceptAll(tokens.select("term", "doc_id", "at")).count() == 0
    # The front beats every pair of its block.
    beaten = F.exists("front", lambda p: (p["count"] >= F.get("counts", F.col("k"))) & (p["length"] <= F.get("lengths", F.col("k"))))
    assert rows.where(~beaten).count() == 0 and rows.agg(F.max("docs")).first()[0] <= 1024


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_first_hits(docs, asked, whole, k):
    full = search.top_k(search.rank_bm25(docs, asked), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, ["doc_id"])
    best = ops.TopHits(whole, asked, k).hits()
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    assert rows(best) == rows(full)


def test_frequent_word_opens_few_postings(spark, tmp_path):
    """Of 20,000 documents with the word, blocks without a document of the first ten stay closed."""
    text = F.concat(F.lit("word "), F.repeat(F.lit("other "), F.pmod(F.xxhash64("id"), F.lit(900)).cast("int")), F.when(F.col("id") % 997 == 3, "word word").otherwise(""))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    index = ops.SearchIndex(spark, str(tmp_path / "i"), 4)
    index.append(docs)
    asked = spark.createDataFrame([(1, "word"), (2, "word other")], "query_id LONG, query STRING")
    best = ops.TopHits(index, asked, 10)
    full = search.top_k(search.rank_bm25(docs, asked), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 10, ["doc_id"])
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    assert rows(best.hits()) == rows(full)
    opened = {r[0]: r[1] for r in best.opened.groupBy("query_id").agg(F.sum("docs")).collect()}
    assert opened[1] < 3_000
    second = ops.page_index(index, asked, 2, 5).where("query_id = 1").orderBy("rank").collect()
    assert [r.rank for r in second] == [1, 2, 3, 4, 5]
    assert [r.doc_id for r in second] == [r.doc_id for r in full.where("query_id = 1 AND rank > 5").orderBy("rank").collect()]


def test_blocks_of_repeated_numbers(spark):
    """A number that comes twice: equal lengths are one entry, other lengths entries by count; blocks split over batches are whole; no aggregate collects rows."""
    rows = [(7, "b a a"), (7, "a b b"), (7, "a a a a"), (300, "a"), (301, "a c"), (-1, "c"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        blocks = ops.posting_blocks(ops.document_terms(docs), 4)
        found = {(r.term, r.block * r.span + r.offsets[0]): r for r in blocks.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in blocks._jdf.queryExecution().toString()
    assert {key: (r.offsets, r.counts, r.lengths, r.places) for key, r in found.items() if key[1] == 7} == {
        ("a", 7): ([7, 7, 300, 301], [3, 4, 1, 1], [3, 4, 1, 2], [[0, 1, 2], [0, 1, 2, 3], [0], [0]]),
        ("b", 7): ([7], [3], [3], [[0, 1, 2]]),
    }
    assert set(found) == {("a", 7), ("b", 7), ("c", -1), ("c", 301)} and found["a", 7].docs == 4
    assert [tuple(p) for p in found["a", 7].front] == [(4, 4), (3, 3), (1, 1)]


def test_first_hits_look_phrases_up_once(spark, asked, docs, whole, monkeypatch):
    calls, counted = [], ops.index_unit_counts
    monkeypatch.setattr(ops, "index_unit_counts", lambda *args: calls.append(1) or counted(*args))
    found = ops.TopHits(whole, asked.where("query_id IN (3, 5)"), 3).hits()
    assert len(calls) == 1 and found.count() > 0
