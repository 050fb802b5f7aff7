"""Page tables, at rest and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def load_spread(spark: SparkSession, path: str, spread_by: str) -> DataFrame:
    """A table for work that costs far more CPU than moving its rows (reading pages, words).

    With fewer splits than the cluster has cores it is spread first; a table with many
    splits stays as it is.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores, spread_by) if table.rdd.getNumPartitions() < cores else table


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages, one row per url."""
    return load_spread(spark, path, "page_id").select("page_id", "url", "html")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Texts with language and source."""
    return load_spread(spark, path, "doc_id")


def load_page_stream(spark: SparkSession, folder: str, files: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Raw pages as they arrive in a folder; the rate per micro-batch is bounded."""
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
