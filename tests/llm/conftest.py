import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977}" for k in range(20_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, long, "en", None),
        (4, long.upper(), "en", "b"),
        (5, "Same text here", "en", "b"),
        (5, "Same text here", "en", "b"),
        (6, "same TEXT here", "en", "b"),
        (7, "one two three", "en", "b"),
        (7, "another text under the same id", "en", "b"),
        (None, "no id at all", "en", "b"),
        (None, "no id at all", "en", "b"),
        (None, None, None, None),
        (8, "a" * 50_000, "en", "c"),
        (9, "ÄÖ ß 　 \x00 \n\n  x", "de", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["row", "run", "digest", "node", "kept", "length", "rank", "bands", "_severity", "_leaks", "_listed", "_print", "spans", "notice", "s", "a", "b", "size"]
    return df.select("*", F.length("text").alias("n_chars"), *[F.lit(name).alias(name) for name in clash]).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
