"""URL filter: a blocked Bloom filter in front of an exact join with the listed URLs.

The list may be long (hundreds of millions of canonical URLs) while few rows are on it.
Its Bloom filter is a table of 256-bit blocks (four longs each); a URL sets and tests eight
bits of one block, so a probe is one equality lookup. Only possible hits meet the list
itself, in an equality join on the whole canonical URL that removes false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import lower_ascii
from pagelake.plans.reuse import materialize

BITS_PER_URL = 16
BLOCK_BITS = 256
WORDS = ["w0", "w1", "w2", "w3"]
# 64 MB of blocks (a block's row is five longs). Above that blocks are joined, not broadcast.
BROADCAST_BLOCKS = 1_600_000
# Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without `www.`, `m.` or default port, path without a last slash, sorted parameters
    without tracking ones; no scheme, no fragment. Null for null and for no `://`."""
    host, path = url_host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(path, r"/+$", ""), tail))


def _bits(url: Column, blocks: int) -> list[Column]:
    """The block of a URL and the four words with its eight bits."""
    block = F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block")
    spots = F.xxhash64(url, F.lit("bits"))
    place = [F.shiftrightunsigned(spots, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(8)]
    words = []
    for w, name in enumerate(WORDS):
        parts = [F.when(F.shiftright(p, 6) == w, F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for p in place]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), parts).alias(name))
    return [block, *words]


def bloom_blocks(listed: DataFrame, url_col: str = "canonical", bits_per_url: int = BITS_PER_URL) -> tuple[DataFrame, int]:
    """The filter of a list of distinct URLs, as (block, w0..w3), and its number of blocks."""
    blocks = max(1, -(-listed.count() * bits_per_url // BLOCK_BITS))
    bits = listed.where(F.col(url_col).isNotNull()).select(*_bits(F.col(url_col), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS]), blocks


def possible_hits(rows: DataFrame, listed: DataFrame, url_col: str = "canonical", bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """The rows with `possible`: false means not on the list, true may be wrong."""
    found, blocks = bloom_blocks(listed, url_col, bits_per_url)
    found = found.select("block", *[F.col(w).alias(f"f_{w}") for w in WORDS])
    probe = rows.select("*", *_bits(F.col(url_col), blocks))
    probe = probe.join(F.broadcast(found) if blocks <= BROADCAST_BLOCKS else found, "block", "left")
    hit = reduce(Column.__and__, [F.col(w).bitwiseAND(F.col(f"f_{w}")) == F.col(w) for w in WORDS])
    return probe.withColumn("possible", F.col(url_col).isNotNull() & F.coalesce(hit, F.lit(False))).select(*rows.columns, "possible")


def on_list(rows: DataFrame, listed: DataFrame, url_col: str = "canonical", bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """The rows with `listed`: whether the canonical URL is on the list, exactly.

    Null URLs are never listed. The list may repeat URLs; rows are neither lost nor repeated.
    """
    urls = listed.select(url_col).where(F.col(url_col).isNotNull()).distinct()
    urls = materialize(urls, "listed-urls")
    probed = materialize(possible_hits(rows, urls, url_col, bits_per_url), "probed-urls")
    marked = urls.withColumn("listed", F.lit(True))
    hits = probed.where("possible").join(marked, url_col, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    misses = probed.where(~F.col("possible")).withColumn("listed", F.lit(False))
    return hits.unionByName(misses).drop("possible")


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule (host and path, like `net/`) that fits and its verdict; null if none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's path. The longest wins.
    """
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r)):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, listed, verdict (allow or block).

    `listed` has the column `canonical`. The longest fitting rule decides; without one, a
    listed URL is blocked and any other allowed. A null URL has empty host and path, fits no rule and is allowed.
    """
    url = F.col(url_col)
    host, path = url_host_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical_url(url).alias("canonical"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    known = F.when(F.col("listed"), "block").otherwise("allow")
    return on_list(rows, listed).select("page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, known).alias("verdict"))
