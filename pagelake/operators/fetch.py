"""Pages to text and links, and the fetch of requested pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake import settings
from pagelake.functions.page_reader import read_page
from pagelake.functions.text import links_section, truncate_content, url_parts
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import keep_listed, skew_join
from pagelake.sources.page_store import PageStore, one_page_per_url

LINK_TYPE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("anchor_text", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
READ_FIELDS = [
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(LINK_TYPE)),
    T.StructField("title", T.StringType()),
    T.StructField("heading", T.StringType()),
    T.StructField("original_content_length", T.IntegerType()),
    T.StructField("error", T.StringType()),
]
ARROW_LINKS = pa.list_(
    pa.struct([("pos", pa.int32()), ("anchor_text", pa.string()), ("href", pa.string()), ("url", pa.string())])
)
ARROW_READ_TYPES = {
    "text": pa.string(),
    "links": ARROW_LINKS,
    "title": pa.string(),
    "heading": pa.string(),
    "original_content_length": pa.int32(),
    "error": pa.string(),
}


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One pass over page bodies: text, links, title, heading, body length, error.

    Other columns pass through as they are; the body goes no further. Being one
    `mapInArrow`, it reads each page once however many of its columns are used, and
    it needs no shuffle: links are made distinct inside their own page.
    """
    kept = [field for field in pages.schema.fields if field.name != html]
    names = [field.name for field in kept]
    if taken := set(names) & set(ARROW_READ_TYPES):
        raise ValueError(f"columns already exist: {sorted(taken)}")

    def read_batches(batches):
        for batch in batches:
            rows = []
            for page_url, body in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist()):
                if body is None:
                    rows.append({"error": settings.PAGE_WITHOUT_BODY})
                else:
                    rows.append({**read_page(page_url, body), "original_content_length": len(body)})
            columns = [batch.column(name) for name in names]
            columns += [pa.array([row.get(name) for row in rows], kind) for name, kind in ARROW_READ_TYPES.items()]
            yield pa.RecordBatch.from_arrays(columns, names + list(ARROW_READ_TYPES))

    return pages.mapInArrow(read_batches, T.StructType(kept + READ_FIELDS))


def with_links_section(parsed: DataFrame) -> DataFrame:
    """`content` is the page text followed by the list of its links."""
    content = F.concat("text", links_section(F.col("links")))
    return parsed.withColumn("content", content).withColumn("content_length", F.length("content"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Page text without its links section."""
    return parse_pages(pages).drop("links", "title", "heading")


def page_links(parsed: DataFrame, page_url: str = "url") -> DataFrame:
    """Link rows (page_url, pos, anchor_text, href, url) in page order."""
    return parsed.select(F.col(page_url).alias("page_url"), F.inline("links"))


def truncate(df: DataFrame, limit, column: str = "content") -> DataFrame:
    """Cut `content` to the limit (number, column, or null) and count it again."""
    return df.withColumn(column, truncate_content(F.col(column), limit)).withColumn(
        f"{column}_length", F.length(column)
    )


# What a page table may tell of the response that a page came with.
RESPONSE_COLUMNS = ["status_code", "headers"]

def pages_at(pages: DataFrame | PageStore, urls: DataFrame) -> DataFrame:
    """Pages whose url is listed, one per url, read and with links.

    A page table is scanned once; of a store only the folders of the listed urls are opened. Bodies
    are parsed for listed urls alone.
    """
    urls = materialize(urls, "listed-urls")
    table = pages.holding(urls) if isinstance(pages, PageStore) else pages
    listed = keep_listed(table, urls, ["url"])
    told = [name for name in RESPONSE_COLUMNS if name in pages.columns]
    return with_links_section(parse_pages(one_page_per_url(listed).select("url", "html", *told)))


def fetch(requests: DataFrame, pages: DataFrame | PageStore, limit: Column | int | None = None, id_column: str = "request_id") -> DataFrame:
    """Each request's page as clean text, or an error row.

    `content_length` counts the cut content; `full_length` the content before the cut.
    A fixed limit is applied once per page, before the page meets its requests. Pages with
    a `status_code` give it to the result, 400 and above as an error; `headers` come along.
    """
    told = [name for name in RESPONSE_COLUMNS if name in pages.columns]
    found = pages_at(pages, requests.select("url").distinct()).select(
        "url", "content", F.col("content_length").alias("full_length"), "original_content_length",
        "title", "heading", "error", *told, F.lit(True).alias("_found"),
    )
    if "status_code" in told:
        refused = F.when(F.col("status_code") >= 400, F.concat(F.lit(settings.HTTP_ERROR), F.col("status_code").cast("string")))
        found = found.withColumn("error", F.coalesce(refused, "error")).withColumn("content", F.when(refused.isNull(), F.col("content")))
    if not isinstance(limit, Column):
        found = truncate(found, limit)
    joined = skew_join(requests, found, ["url"], "left", [id_column])
    failed = F.when(F.col("_found").isNull(), F.lit(settings.PAGE_NOT_FOUND)).otherwise(F.col("error"))
    rows = (
        joined.withColumn("error", failed)
        .withColumn("status_code", F.coalesce("status_code", F.when(F.col("error").isNull(), 200)) if "status_code" in told else F.when(F.col("error").isNull(), F.lit(200)))
        .drop("_found")
    )
    return truncate(rows, limit) if isinstance(limit, Column) else rows


def render_fetch(fetched: DataFrame) -> DataFrame:
    """The fetch report as one text per request; its length line counts before the cut."""
    report = F.concat(
        F.lit("Fetched content from: "), F.col("url"),
        F.lit("\nStatus Code: "), F.col("status_code").cast("string"),
        F.lit("\nOriginal Content Length: "), F.col("original_content_length").cast("string"),
        F.lit(" characters\nClean Text Length: "), F.col("full_length").cast("string"),
        F.lit(" characters\n\nClean Text Content:\n"), F.col("content"),
    )
    return fetched.withColumn(
        "report",
        F.when(F.col("error").isNotNull(), F.concat(F.lit(settings.FETCH_ERROR), F.col("error"))).otherwise(report),
    )


def with_url_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("parsed_url", url_parts(F.col("url")))
