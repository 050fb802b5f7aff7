"""Clean pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelake.operators.fetch import parse_pages, truncate, with_links_section


def stream_clean(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Arriving pages to clean text with its links section; stateless, append mode."""
    return truncate(with_links_section(parse_pages(pages)).drop("links"), limit)
