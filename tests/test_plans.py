import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelake.functions.text import snippet, truncate_content
from pagelake.operators import fetch
from pagelake.operators.records import validate_records
from pagelake.operators.schema import compile_schema
from pagelake.plans import reuse, skew
from pagelake.plans.asof import as_of
from pagelake.sources import page_store

PAGES = "/root/testdata/sf0.001/pages.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(left, ["k"], rows=500)
    assert [row.k for row in hot.collect()] == [0] and hot.first()._slots >= 2
    assert skew.hot_keys(left, ["k"]) is None
    joined = skew.skew_join(left, right, ["k"], how, ["id"], rows=500)
    assert rows_of(joined.select("id", "k", "v")) == rows_of(left.join(right, ["k"], how).select("id", "k", "v"))


def test_lookup_join_both_ways(spark, monkeypatch):
    left = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    small = skew.lookup_join(left, right, ["k"], "inner", ["id"])
    assert not skew.fits(right, 10) and skew.fits(right, 10**6)
    monkeypatch.setattr(skew, "fits", lambda df: False)
    large = skew.lookup_join(left, right, ["k"], "inner", ["id"])
    assert "ResolvedHint (strategy=broadcast)" not in large._jdf.queryExecution().analyzed().toString()
    assert rows_of(small) == rows_of(large) == rows_of(skew.skew_join(left, right, ["k"], "inner", ["id"], rows=10))


def test_null_keys_of_a_left_join_are_spread(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"))
    right = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = skew.skew_join(left, right, ["k"], "left", ["id"], rows=100)
    assert rows_of(joined.select("id", "k", "v")) == rows_of(left.join(right, ["k"], "left").select("id", "k", "v"))
    assert {row._slots for row in skew.hot_keys(left, ["k"], rows=100).where("k IS NULL").collect()} == {10}


def files_read(df):
    assert "PartitionFilters: [bucket" in plan(df) or "PartitionFilters: [isnotnull(bucket" in plan(df)
    return {r[0].rsplit("/", 2)[1] for r in df.select(F.input_file_name()).distinct().collect()}


def test_store_opens_only_folders_of_asked_urls(spark, tmp_path):
    pages = spark.read.parquet(PAGES)
    page_store.write_page_store(pages, str(tmp_path), 16)
    store = page_store.PageStore(spark, str(tmp_path))
    assert store.buckets == 16 and store.columns == pages.columns and rows_of(store.table().drop("bucket")) == rows_of(pages)
    urls = pages.where("page_id IN (2, 7)").select("url")
    wanted = {f"bucket={r[0]}" for r in urls.select(page_store.bucket_of(F.col("url"), 16)).collect()}
    assert files_read(store.holding(urls)) == wanted and len(wanted) < 16
    found = fetch.pages_at(store, urls.unionByName(spark.createDataFrame([(None,), ("http://gone/",)], "url STRING")))
    assert rows_of(found) == rows_of(fetch.pages_at(pages, urls)) and found.count() == 2
    assert fetch.pages_at(store, urls.where("1 = 0")).count() == 0


def test_hundred_thousand_urls_read_their_folders(spark, tmp_path):
    pages = spark.range(200_000).select("id", F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("<p>x</p>").alias("html"))
    page_store.write_page_store(pages.withColumnRenamed("id", "page_id"), str(tmp_path), 64)
    store = page_store.PageStore(spark, str(tmp_path))
    every = page_store.bucket_of(F.col("url"), 64)
    urls = pages.where(every % 4 == 1).select("url").unionByName(pages.where(every % 4 == 3).select(F.concat("url", F.lit("/none")).alias("url")).where(every % 4 == 1))
    urls = urls.unionByName(pages.select("url").where(every % 4 == 1))
    assert urls.count() >= 100_000
    assert files_read(store.holding(urls)) == {f"bucket={k}" for k in range(1, 64, 4)}
    assert fetch.pages_at(store, urls.distinct()).count() == pages.where(every % 4 == 1).count()


def test_store_grows(spark, tmp_path):
    """Added pages are seen, repeated ones count once, and the number of buckets stays."""
    rows = lambda *r: spark.createDataFrame(list(r), "page_id LONG, url STRING, html STRING")
    page_store.write_page_store(rows((5, "u", "<p>five</p>"), (6, None, "x"), (7, "w", "<p>w</p>")), str(tmp_path), 4)
    page_store.write_page_store(rows((3, "u", "<p>three</p>"), (7, "w", "<p>w</p>")), str(tmp_path), 99)
    store = page_store.PageStore(spark, str(tmp_path))
    found = fetch.pages_at(store, rows((0, "u", ""), (0, "w", "")).select("url")).collect()
    assert store.buckets == 4 and {(r.url, r.text) for r in found} == {("u", "three"), ("w", "w")}


def test_choice_among_equal_ids_does_not_depend_on_order(spark):
    rows = [(1, "u", "<p>one</p>"), (1, "u", "<p>two</p>"), (1, "u", "<p>two</p>"), (None, "v", "a"), (None, "v", None), (4, "w", "w"), (2, None, "n"), (2, None, "n")]
    chosen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        table = spark.createDataFrame(order, "page_id LONG, url STRING, html STRING").repartition(3)
        kept = page_store.one_page_per_url(table).where("url IS NOT NULL")
        chosen.add(tuple(map(tuple, rows_of(kept))))
        bare = page_store.one_page_per_url(table.drop("page_id")).where("url IS NOT NULL")
        assert bare.count() == 3
    assert len(chosen) == 1 and len(chosen.pop()) == 3


def test_top_k_ways_agree(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("k"), (F.col("id") * 7919 % 5000).alias("s"))
    order = [F.col("s").desc(), F.col("id")]
    fixed = skew.top_k(rows, ["k"], order, 5, ["id"])
    column = skew.top_k(rows.withColumn("n", F.lit(5)), ["k"], order, F.col("n"), ["id"]).drop("n")
    assert rows_of(fixed) == rows_of(column) and fixed.count() == 35
    assert "WindowGroupLimit" in plan(fixed)
    assert skew.top_k(rows, ["k"], order, 1200, ["id"]).count() == sum(min(1200, n) for n in [r["count"] for r in rows.groupBy("k").count().collect()])


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_against_brute_force(spark, width):
    rng = random.Random(width)
    entries = [(rng.choice("abc"), rng.randrange(-50, 300), i) for i in range(200)]
    asked = [(rng.choice("abcd"), rng.randrange(-60, 320), i) for i in range(200)]
    found = as_of(
        spark.createDataFrame(asked, "k STRING, t LONG, id INT"), spark.createDataFrame(entries, "k STRING, e LONG, v INT"), ["k"], "t", "e", width
    )
    for row in found.collect():
        best = max(((e, v) for k, e, v in entries if k == row.k and e <= row.t), default=None)
        assert (tuple(row.found) if row.found else None) == best
    assert found.count() == 200


def test_materialized_table_goes_to_the_shared_folder(spark):
    table = reuse.materialize(spark.range(10), "t")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder.rstrip("/") in table.inputFiles()[0] and table.count() == 10


def test_scratch_scope_removes_its_tables(spark):
    with reuse.scratch_scope(spark):
        path = reuse.materialize(spark.range(3)).inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert Path(path).exists()
    assert not Path(path).exists()


def test_pages_are_read_once_and_narrowly(spark):
    pages = spark.read.parquet(PAGES)
    content = fetch.with_links_section(fetch.parse_pages(pages))
    text = plan(fetch.truncate(content, 100).where("error IS NULL").select("page_id", "content", "content_length"))
    assert text.count("MapInArrow") == 1 and "Exchange" not in text
    assert "html" not in plan(fetch.with_url_parts(pages).select("page_id", "parsed_url"))
    filtered = plan(pages.where("page_id = 3").select("url"))
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,3)]" in filtered


def test_native_operators_have_no_python(spark):
    rows = spark.createDataFrame([("x", '{"n": "5 kg"}')], "content STRING, r STRING")
    checked = validate_records(rows, "r", compile_schema({"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}))
    shown = checked.select("data", truncate_content(F.col("content"), 5), snippet(F.col("content"), 3))
    text = plan(shown)
    assert "Python" not in text and "MapIn" not in text and "Exchange" not in text
