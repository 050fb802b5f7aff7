"""One hop from seed pages along their links."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake import settings
from pagelake.functions.text import as_array, truncate_content
from pagelake.operators.containment import contained
from pagelake.operators.fetch import pages_at, truncate
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import keep_listed, skew_join, top_k
from pagelake.sources.page_store import PageStore


class Crawl(NamedTuple):
    """main: one row per seed; subpages: the pages reached; summary: counts per seed."""

    main: DataFrame
    subpages: DataFrame
    summary: DataFrame


def anchor_matches(anchor: Column, filters: Column) -> Column:
    """Any filter inside the anchor, ignoring case. No filters match everything."""
    lowered = F.lower(anchor)
    return F.coalesce(F.size(filters) <= 0, F.lit(True)) | F.exists(filters, lambda f: F.contains(lowered, F.lower(f)))


def filter_links(links: DataFrame, filters) -> DataFrame:
    """Link rows whose anchor fits; filters are a list or an array column.

    Links must be distinct per page already: a url first seen under an anchor that does
    not fit is gone, even if a later anchor would fit.
    """
    filters = as_array(filters)
    return links.where(filters.isNull() | anchor_matches(F.col("anchor_text"), filters))


def filter_links_table(links: DataFrame, filters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Link rows whose anchor holds, ignoring case, any filter of a table (keys, filter) for its keys.

    Keys are columns of both, such as the seed; without any, all filters apply to all links. A key without
    a filter in the table keeps all its links, and so does an empty table. A null anchor fits no filter.
    """
    keys = keys or []
    lowered = filters.where(F.col("filter").isNotNull()).select(*keys, F.lower("filter").alias("_filter"))
    anchors = links.withColumn("_anchor", F.lower("anchor_text"))
    fitting = contained(anchors, lowered, "_anchor", "_filter", keys).select(*keys, "_anchor").distinct()
    kept = anchors.join(fitting, [*keys, "_anchor"], "left_semi").drop("_anchor")
    if keys:
        return kept.unionByName(links.join(lowered.select(*keys).distinct(), keys, "left_anti"))
    return kept if lowered.head(1) else links


def select_subpages(links: DataFrame, k: int = settings.DEFAULT_SUBPAGE_LIMIT, seed: str = "page_url") -> DataFrame:
    """The first k links of each seed in page order."""
    return top_k(links, [seed], [F.col("pos")], max(k, 0), ["url"])


def nest_links(links: DataFrame) -> DataFrame:
    """Link rows back to one array per page; it is as long as the page's own link list."""
    row = F.struct("pos", "anchor_text", "href", "url")
    return links.groupBy(F.col("page_url").alias("url")).agg(F.array_sort(F.collect_list(row)).alias("links"))


def crawl(
    seeds: DataFrame,
    pages: DataFrame | PageStore,
    subpage_limit: int = settings.DEFAULT_SUBPAGE_LIMIT,
    max_content_length: int | None = None,
    links: DataFrame | None = None,
) -> Crawl:
    """Seeds (seed_id, url, filters?) to their pages and the first fitting subpages.

    The seeds may have columns `subpage_limit` and `max_content_length` of their own.

    Filtering and the cut to `subpage_limit` happen inside each page's link array, so
    only chosen links are shuffled. Every page is read once: pages that are both seed
    and subpage reuse the seed's text. A chosen subpage that does not exist is lost and
    no other link takes its place. `links` (page_url, pos, anchor_text, href, url)
    replaces the links found in the pages.
    """
    if "filters" not in seeds.columns:
        seeds = seeds.withColumn("filters", F.lit(None).cast("array<string>"))
    read = materialize(pages_at(pages, seeds.select("url").distinct()), "seed-pages")
    text = read.select("url", "content", "content_length", "error")
    linked = read.select("url", "error", "links")
    if links is not None:
        # Only the seeds' own links are gathered.
        seeds_read = linked.select(F.col("url").alias("page_url"))
        links = keep_listed(links, seeds_read, ["page_url"])
        linked = linked.drop("links").join(nest_links(links), "url", "left")

    kept = F.filter(
        F.coalesce("links", F.array().cast("array<struct<pos:int,anchor_text:string,href:string,url:string>>")),
        lambda link: F.col("filters").isNull() | anchor_matches(link["anchor_text"], F.col("filters")),
    )
    limit = F.greatest(F.col("subpage_limit") if "subpage_limit" in seeds.columns else F.lit(subpage_limit), F.lit(0))
    own = [name for name in ("subpage_limit", "max_content_length") if name in seeds.columns]
    found = skew_join(seeds.select("seed_id", "url", "filters", *own), linked.withColumn("_found", F.lit(True)), ["url"], "left", ["seed_id"])
    error = F.when(F.col("_found").isNull(), F.lit(settings.PAGE_NOT_FOUND)).otherwise(F.col("error"))
    kept = F.when(error.isNull(), kept)
    # Narrow from here on: a seed keeps its counts and at most `subpage_limit` links.
    asked = materialize(
        found.withColumns({"error": error, "kept": kept}).select(
            "seed_id", "url", "filters", "error", *own,
            F.size("kept").alias("links_found"),
            F.slice("kept", F.lit(1), limit).alias("chosen"),
        ),
        "chosen-links",
    )
    own_cut = [name for name in own if name == "max_content_length"]
    chosen = asked.select("seed_id", *own_cut, F.inline("chosen")).select("seed_id", "pos", "anchor_text", "url", *own_cut)

    targets = chosen.select("url").distinct()
    unread = targets.join(text.select("url"), "url", "left_anti")
    extra = materialize(pages_at(pages, unread).select(*text.columns), "subpages")
    reachable = keep_listed(text, targets, ["url"]).unionByName(extra).where(F.col("error").isNull()).drop("error")
    # A common cut is made once per page, before the page meets its seeds.
    subpages = skew_join(chosen, truncate(reachable, None if own_cut else max_content_length), ["url"], "inner", ["seed_id"])
    if own_cut:
        subpages = truncate(subpages, F.col("max_content_length")).drop("max_content_length")

    main = skew_join(asked.select("seed_id", "url", "error"), text.drop("error"), ["url"], "left", ["seed_id"])
    return Crawl(main, subpages, crawl_summary(asked, subpages))


def crawl_summary(asked: DataFrame, subpages: DataFrame) -> DataFrame:
    """Per seed: links that fit, subpages that came back, filters. Failed seeds have only their error."""
    returned = subpages.groupBy("seed_id").agg(F.count(F.lit(1)).alias("returned"))
    good = F.col("error").isNull()
    return asked.join(returned, "seed_id", "left").select(
        "seed_id",
        "url",
        "error",
        F.when(good, F.col("links_found")).alias("total_subpages_found"),
        F.when(good, F.coalesce(F.col("returned"), F.lit(0))).cast("int").alias("subpages_returned"),
        F.when(good, F.col("filters")).alias("filters_applied"),
    )


def render_crawl(crawled: Crawl, max_content_length: int | None = None) -> DataFrame:
    """One report per seed; a seed has no more subpages than its limit."""
    entry = F.concat(
        F.col("anchor_text"),
        F.lit("\n   URL: "), F.col("url"),
        F.lit("\n   Content Length: "), F.col("content_length").cast("string"),
        F.lit(" characters\n   Content: "), F.col("content"), F.lit("\n" + "-" * 30 + "\n"),
    )
    listed = (
        crawled.subpages.groupBy("seed_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("listed"))
    )
    numbered = F.transform(
        F.col("listed.entry"), lambda text, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), text)
    )
    counts = crawled.summary.select("seed_id", "total_subpages_found", "subpages_returned", "filters_applied")
    double = "=" * 50
    report = F.concat(
        F.lit("Crawled: "), F.col("url"),
        F.lit("\nMain page content length: "), F.col("content_length").cast("string"),
        F.lit(" characters\nTotal subpages found: "), F.col("total_subpages_found").cast("string"),
        F.lit("\nSubpages returned: "), F.col("subpages_returned").cast("string"), F.lit("\n"),
        F.when(
            F.size("filters_applied") > 0,
            F.concat(F.lit("Filters applied: "), F.array_join("filters_applied", ", "), F.lit("\n")),
        ).otherwise(F.lit("")),
        F.lit(f"\n{double}\nMAIN PAGE CONTENT:\n{double}\n"),
        truncate_content(F.col("content"), max_content_length), F.lit("\n\n"),
        F.when(
            F.col("listed").isNotNull(), F.concat(F.lit(f"{double}\nSUBPAGES:\n{double}\n"), F.array_join(numbered, ""))
        ).otherwise(F.lit("")),
    )
    return (
        crawled.main.join(counts, "seed_id")
        .join(listed, "seed_id", "left")
        .select(
            "seed_id",
            F.when(F.col("error").isNotNull(), F.concat(F.lit("Crawl error: "), F.col("error"))).otherwise(report).alias("report"),
        )
    )

