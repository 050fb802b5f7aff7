"""Main text of pages by host suffix order.

The token streams of all pages of a host are laid end to end and their suffixes brought
together by their first MIN_RUN tokens: that is the host's suffix array down to the depth
that matters, with one run of the array per group, dealt out by (host, group) so
that no task holds a host. A group with suffixes of enough distinct pages is a substring repeated
across pages; the tokens of its occurrences are covered. Overlapping occurrences
make up longer repeats, as in a full suffix array.

Blocks that are mostly covered are boilerplate and go; blocks with unique runs stay.
With `trust_markup` the page's own markup has the first word: what stands in menus, headers,
footers, forms, adverts, notices or reader comments goes, what stands in an article or main
element stays, and the suffix order decides every other block, on pages with an article as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.page_blocks import CHROME, MAIN, OPEN, page_blocks
from pagelake.llm.shared import numbered
from pagelake.llm.url_filter import url_host_path
from pagelake.plans.reuse import materialize

MIN_RUN = 8
LEAST_PAGES = 3
LEAST_SHARE = 0.3
MOST_COVERED = 0.5
BROADCAST_GROUPS = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_TYPE = pa.list_(pa.struct([("zone", pa.int8()), ("text", pa.string())]))


def suffix_heads(tokens: list[str], run: int = MIN_RUN) -> np.ndarray:
    """A 64-bit name of the first `run` tokens of every suffix that has as many."""
    if len(tokens) < run:
        return np.empty(0, np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    name = np.zeros(len(tokens) - run + 1, np.uint64)
    for k in range(run):
        name = (name ^ hashes[k : len(tokens) - run + 1 + k]) * MIX
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def covered_tokens(heads: np.ndarray, repeated: set[int], tokens: int, run: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in an occurrence of a repeated substring."""
    marks = np.zeros(tokens + 1, np.int64)
    for at, head in enumerate(heads.tolist()):
        if head in repeated:
            marks[at] += 1
            marks[at + run] -= 1
    return np.cumsum(marks[:-1]) > 0


def streams(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks that the suffix order has to judge: all but the article's own."""
    return [b for b in blocks if b[0] != MAIN]


def parse(pages: DataFrame, run: int, trust_markup: bool, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: text if markup decides all of it (else null), else its blocks, suffix heads, digest of the blocks. Written once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, left, heads, contents = [], [], [], []
            for page in batch.column(3):
                blocks = page_blocks(page.as_py())
                if not trust_markup:
                    blocks = [(OPEN, text) for _, text in blocks]
                article = [text for zone, text in blocks if zone == MAIN]
                tokens = [t for _, text in streams(blocks) for t in text.split()]
                decided = bool(article) and all(zone != OPEN for zone, _ in blocks)
                texts.append("\n".join(article) if decided else None)
                left.append([] if decided else [{"zone": z, "text": t} for z, t in blocks])
                heads.append(suffix_heads(tokens, run))
                contents.append(xxhash.xxh3_64_intdigest("\n".join(t for _, t in blocks)) - (1 << 63))
            columns = [pa.array(texts, pa.string()), pa.array(left, BLOCK_TYPE), pa.array(heads, pa.list_(pa.int64())), pa.array(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "url", "host", "text", "blocks", "heads", "content"])

    host, _ = url_host_path(F.col(url_col))
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    kind = narrow.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, text string, blocks array<struct<zone tinyint, text string>>, heads array<long>, content long"
    return numbered(narrow.mapInArrow(read, schema), "parsed-pages")


def repeated_heads(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, head) of substrings that stand on enough distinct pages of a host. Equal pages count once."""
    distinct = parsed.groupBy("host", "content").agg(F.min("row").alias("row"))
    pages = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    own = parsed.select("row", "host", F.explode(F.array_distinct("heads")).alias("head")).join(distinct.select("row"), "row", "left_semi")
    groups = own.groupBy("host", "head").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= least_pages)
    return groups.join(pages, "host").where(F.col("on") >= least_share * F.col("pages")).select("host", "head")


def main_text(
    pages: DataFrame,
    run: int = MIN_RUN,
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    trust_markup: bool = True,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, url, text (blocks by newline, empty if none), n_chars, covered.

    `covered` counts the repeated tokens of a page that the suffix order judged; it is null where
    markup decided every block: an article and nothing left open. All pages lend their tokens outside the article as evidence.
    Null html is empty; pages with null or odd urls share the host ''. Repeated rows each get a row.
    """
    parsed = parse(pages, run, trust_markup, id_col, url_col, html_col)
    repeated = materialize(repeated_heads(parsed, least_pages, least_share), "repeated-heads")
    # Only pages that markup leaves open meet the repeated substrings; their text moves, that of others doesn't.
    undecided = parsed.where(F.col("text").isNull())
    spots = undecided.select("row", "host", F.explode(F.array_distinct("heads")).alias("head"))
    small = repeated.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    hits = spots.join(F.broadcast(repeated) if small else repeated, ["host", "head"])
    found = hits.groupBy("row").agg(F.collect_set("head").alias("repeated"))  # a page's own heads at most
    judged = undecided.join(found, "row", "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for blocks, heads, repeats in zip(*(batch.column(k).to_pylist() for k in range(2, 5))):
                known = set(repeats or ())
                tokens = len(heads) + run - 1 if heads else 0
                covered = covered_tokens(np.array(heads, np.int64), known, tokens, run) if known else np.zeros(tokens, bool)
                stay, at = [], 0
                for block in blocks:
                    if block["zone"] == MAIN:  # not in the stream
                        stay.append(block["text"])
                        continue
                    n = len(block["text"].split())
                    share = covered[at : at + n].mean() if len(covered) else 0.0
                    if block["zone"] != CHROME and share <= MOST_COVERED:
                        stay.append(block["text"])
                    at += n
                texts.append("\n".join(stay))
                counts.append(int(covered.sum()))
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["page_id", "url", "text", "n_chars", "covered"])

    kind = parsed.schema["page_id"].dataType.simpleString()
    wide = judged.select("page_id", "url", "blocks", "heads", "repeated")
    settled = wide.mapInArrow(settle, f"page_id {kind}, url string, text string, n_chars long, covered long")
    decided = parsed.where(F.col("text").isNotNull())
    plain = decided.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("long").alias("covered"))
    return plain.unionByName(settled)

