"""A page table kept by url: dealt into folders by a hash of the url, so that a look-up reads the folders of the asked urls alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.plans.reuse import materialize
from pagelake.plans.skew import keep_listed

# A folder of a large store should hold about as many bytes as one task reads: page bytes / 64 MB.
BUCKETS = 64


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def write_page_store(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write pages, or add them to the store at the path, which keeps the number of buckets it began with.

    Each bucket gets one sorted file per call; of pages with one url one is kept. Null urls are never
    asked for and stay out. Adding the same pages again does no harm, as a look-up gives one page per url.
    """
    spark = pages.sparkSession
    spark.createDataFrame([(buckets,)], "buckets INT").write.mode("ignore").parquet(f"{path}/layout")
    kept = one_page_per_url(pages.where(F.col("url").isNotNull()))
    placed = kept.withColumn("bucket", bucket_of(F.col("url"), _buckets(spark, path)))
    dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "url")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/pages")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/layout").first()["buckets"]


class PageStore:
    """Pages at a path. Stands where a page table may stand in fetch, crawl and extract, at rest and per micro-batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.buckets = spark, path, _buckets(spark, path)

    def table(self) -> DataFrame:
        """All pages as they are stored now."""
        return self.spark.read.parquet(f"{self.path}/pages")

    @property
    def columns(self) -> list[str]:
        return [name for name in self.table().columns if name != "bucket"]

    def holding(self, urls: DataFrame) -> DataFrame:
        """The pages in the folders of the listed urls. The list is reduced to bucket numbers, of which there
        are no more than buckets; other folders are not opened, for their urls neither."""
        asked = urls.where(F.col("url").isNotNull()).select(bucket_of(F.col("url"), self.buckets).alias("bucket")).distinct()
        numbers = sorted(row["bucket"] for row in asked.collect())
        return self.table().where(F.col("bucket").isin(numbers) if numbers else F.lit(False)).drop("bucket")


def one_page_per_url(pages: DataFrame) -> DataFrame:
    """Of several page rows with one url the one with the least page_id (null first), then with the least
    hash of its other columns, so the choice does not depend on the order of rows. Null urls are one url.

    Repeated urls are found on urls alone; only their rows are compared and moved.
    """
    repeated = pages.groupBy("url").count().where("count > 1 AND url IS NOT NULL").select("url")
    if not repeated.head(1):
        return pages
    repeated = materialize(repeated, "repeated-urls")
    ids = [name for name in ("page_id",) if name in pages.columns]
    rest = [name for name in pages.columns if name not in ("url", *ids)]
    tie = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256) if rest else F.lit("")
    several = keep_listed(pages, repeated, ["url"]).withColumn("_place", F.struct(*ids, tie.alias("tie")))
    first = materialize(several.groupBy("url").agg(F.min("_place").alias("_first")), "first-pages").withColumnRenamed("url", "_url")
    same = (F.col("url") == F.col("_url")) & F.col("_place").eqNullSafe(F.col("_first"))
    chosen = several.join(first, same, "left_semi").dropDuplicates(["url"]).drop("_place")
    return keep_listed(pages, repeated, ["url"], "left_anti").unionByName(chosen)
