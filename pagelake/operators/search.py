"""Match, rank, merge, page, count and render search results."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake import settings
from pagelake.functions.text import snippet
from pagelake.operators.containment import found_in_texts
from pagelake.operators.requests import normalise_requests, split_valid, validate_requests
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import fits, lookup_join, skew_join, top_k

K1, B = 1.2, 0.75
RRF_OFFSET = 60
SCORE_PLACES = 10
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words in text order."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def query_needs(queries: DataFrame) -> DataFrame:
    """What each query asks for: (query_id, unit, phrase) with one row per bare or quoted
    word and one per quoted phrase of several words (its words joined by a space)."""
    quoted = F.regexp_extract_all("query", F.lit('"([^"]*)"'), 1)
    phrases = F.transform(quoted, lambda text: F.array_join(words(text), " "))
    terms = F.transform(words(F.col("query")), lambda word: F.struct(word.alias("unit"), F.lit(False).alias("phrase")))
    several = F.transform(
        F.filter(phrases, lambda text: text.contains(" ")),
        lambda text: F.struct(text.alias("unit"), F.lit(True).alias("phrase")),
    )
    return queries.select("query_id", F.inline(F.array_distinct(F.concat(terms, several))))


# A last token that every document has and no word equals: its counts are the documents and their lengths.
END = ""


def doc_words(docs: DataFrame) -> DataFrame:
    """Words of each document and END, and the number of words. Null text has none."""
    found = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    tokens = docs.select("doc_id", F.concat(found, F.array(F.lit(END))).alias("tokens"))
    return tokens.withColumn("doc_len", F.size("tokens") - 1)


def unit_counts(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """(doc_id, doc_len, unit, phrase, tf) for the asked units, and for END one row per document.

    Every group holds one document's rows and all of them start in one task, so counts
    are complete before the shuffle.
    """
    end = needs.sparkSession.range(1).select(F.lit(END).alias("unit"), F.lit(False).alias("phrase"))
    units = needs.select("unit", "phrase").unionByName(end).distinct().withColumn("unit_words", F.split("unit", " "))
    # The outer form keeps the optimizer from splitting every text once more to drop empty ones.
    tokens = doc_words(docs).select("doc_id", "doc_len", "tokens", F.posexplode_outer("tokens").alias("at", "word"))
    placed = broadcast_units(tokens, units) if fits(units) else aligned_units(tokens.drop("tokens"), units)
    return placed.groupBy("doc_id", "doc_len", "unit", "phrase").agg(F.count(F.lit(1)).alias("tf"))


def broadcast_units(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """One row per place of a unit: its first word matches and, for phrases, the words after it."""
    size = F.size("unit_words")
    begins = F.col("word") == F.col("unit_words")[0]
    follows = ~F.col("phrase") | (F.slice("tokens", F.col("at") + 1, size) == F.col("unit_words"))
    return tokens.join(F.broadcast(units), begins & follows).select("doc_id", "doc_len", "unit", "phrase")


def aligned_units(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """The same for more units than fit a broadcast, by words alone: words meet in a join
    that spreads frequent ones, and a phrase is where all its words have the same start."""
    parts = units.select("unit", "phrase", F.size("unit_words").alias("unit_len"), F.posexplode("unit_words").alias("offset", "word"))
    found = skew_join(tokens, parts, ["word"], "inner", ["doc_id", "at"])
    start = (F.col("at") - F.col("offset")).alias("start")
    aligned = found.groupBy("doc_id", "doc_len", "unit", "phrase", "unit_len", start).agg(F.count(F.lit(1)).alias("words"))
    return aligned.where(F.col("words") == F.col("unit_len")).select("doc_id", "doc_len", "unit", "phrase")


def match_documents(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document has all words and all phrases of the query."""
    return rank_bm25(docs, queries).select("query_id", "doc_id")


def match_substrings(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document has all bare words of the query and holds each quoted phrase as
    a substring, ignoring case: `"book shop"` is in "bookshops" no more than in "books", but `"ook"` is in both.

    All phrases are looked for in one pass over the texts.
    """
    outside = F.regexp_replace("query", '"[^"]*"', " ")
    bare = queries.select("query_id", F.explode(F.array_distinct(words(outside))).alias("unit"))
    quoted = F.regexp_extract_all("query", F.lit('"([^"]+)"'), 1)
    held = queries.select("query_id", F.explode(F.array_distinct(F.transform(quoted, F.lower))).alias("unit"))
    needs = bare.withColumn("phrase", F.lit(False)).unionByName(held.withColumn("phrase", F.lit(True)))
    needs = materialize(needs, "query-needs")
    single = unit_counts(docs, needs.where(~F.col("phrase"))).where(F.col("unit") != END).select("doc_id", "unit", "phrase")
    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    phrases = found_in_texts(lowered, needs.where("phrase").select(F.col("unit").alias("pattern")))
    units = materialize(single.unionByName(phrases.select("doc_id", F.col("pattern").alias("unit"), F.lit(True).alias("phrase"))), "document-units")
    wanted = needs.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    # A query starts from its rarest unit.
    known = lookup_join(needs, units.groupBy("unit", "phrase").agg(F.count(F.lit(1)).alias("df")), ["unit", "phrase"], "left", ["query_id"])
    rarest = known.groupBy("query_id").agg(F.min(F.struct("df", "unit", "phrase")).alias("r"), F.count("df").alias("known")).join(wanted, "query_id")
    rarest = rarest.where("known = wanted").select("query_id", "r.unit", "r.phrase")
    begun = lookup_join(units, rarest, ["unit", "phrase"], "inner", ["doc_id"]).select("query_id", "doc_id")
    asked = lookup_join(begun, needs.join(wanted, "query_id"), ["query_id"], "inner", ["doc_id"])
    met = asked.join(units, ["doc_id", "unit", "phrase"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("got"), F.max("wanted").alias("wanted"))
    return met.where("got = wanted").select("query_id", "doc_id")


def rank_bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Matching documents per query with a BM25 score over the query's words.

    Texts are read once. A query starts from its rarest unit: only documents that have that
    one meet the query at all, so a frequent word costs as many rows as the query's rarest.
    """
    needs = materialize(query_needs(queries), "query-needs")
    counted = materialize(unit_counts(docs, needs), "unit-counts")
    sizes = counted.where(F.col("unit") == END).agg(F.struct(F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("mean_len"))).scalar()
    total, mean_len = sizes["docs"], sizes["mean_len"]
    return scored_hits(needs, counted.where(F.col("unit") != END), total, mean_len, k1, b)


def scored_hits(needs: DataFrame, counts: DataFrame, total: Column, mean_len: Column, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) from what queries need and a written table of unit counts (doc_id, doc_len, unit, phrase, tf)."""
    spread = counts.groupBy("unit", "phrase").agg(F.count(F.lit(1)).alias("df"))
    wanted = needs.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = needs.join(wanted, "query_id").join(spread, ["unit", "phrase"], "left").withColumn("idf", idf)
    asked = materialize(asked, "asked-units")
    rarest = asked.groupBy("query_id").agg(F.count("df").alias("known"), F.max("wanted").alias("wanted"), F.min(F.struct("df", "unit", "phrase")).alias("r"))
    rarest = rarest.where("known = wanted").select("query_id", "r.unit", "r.phrase")
    begun = lookup_join(counts.select("doc_id", "unit", "phrase"), rarest, ["unit", "phrase"], "inner", ["doc_id"])
    begun = begun.select("query_id", "doc_id")
    pairs = lookup_join(begun, asked.drop("df"), ["query_id"], "inner", ["doc_id"])
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / mean_len))
    # Each row knows how many units its query wants, so hits of one query need not meet again.
    return (
        pairs.join(counts, ["doc_id", "unit", "phrase"])
        .groupBy("query_id", "doc_id")
        .agg(
            F.count(F.lit(1)).alias("got"),
            F.max("wanted").alias("wanted"),
            F.sum(F.when(~F.col("phrase"), part)).alias("score"),
        )
        .where(F.col("got") == F.col("wanted"))
        # Sums differ in the last place with the order of their parts; equal texts shall tie.
        .select("query_id", "doc_id", F.round("score", SCORE_PLACES).alias("score"))
    )


def found_positions(hits: DataFrame) -> DataFrame:
    """Per query and url: (position, engine) of its engines in order, an engine at its best position, and the fused score.

    No text takes part. The first step folds repeated hits before the shuffle, so the lists are no longer than
    the engine list.
    """
    best = hits.groupBy("query_id", "url", "engine").agg(F.min("position").alias("position"))
    return best.groupBy("query_id", "url").agg(
        F.array_sort(F.collect_list(F.struct("position", "engine"))).alias("found"),
        F.round(F.sum(1 / (F.lit(RRF_OFFSET) + F.col("position"))), SCORE_PLACES).alias("score"),
    )


def merge_engines(hits: DataFrame) -> DataFrame:
    """One row per query and url from the hit lists of several engines.

    An engine counts once per url, at its best position. Score: reciprocal rank fusion. Title and
    content are those of the first engine's hit (of several at one place the least title, then content).
    Only such hits carry their text past the join; the hits are read twice, the first time without text. Null
    queries, urls and engines are values of their own.
    """
    hits = hits.select("query_id", "url", "engine", "position", "title", "content")
    merged = materialize(found_positions(hits), "merged-hits")
    keys = ["query_id", "url"]
    leads = merged.withColumns({"engine": F.col("found")[0]["engine"], "position": F.col("found")[0]["position"]})
    leads = leads.withColumnsRenamed({name: f"_{name}" for name in [*keys, "engine", "position"]})
    same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in [*keys, "engine", "position"]])
    winners = hits.join(F.broadcast(leads) if fits(merged) else leads, same)
    first = top_k(winners, keys, [F.col("title"), F.col("content")], 1, ["title", "content"], rank="_rank")
    return first.select(
        *keys,
        "title",
        "content",
        "engine",
        F.array_sort("found.engine").alias("engines"),
        F.col("found.position").alias("positions"),
        "score",
    )


def page_results(
    hits: DataFrame,
    pageno: Column | int = 1,
    page_size: int | None = None,
    max_results: Column | int = settings.DEFAULT_RESULTS_LIMIT,
    id_column: str = "doc_id",
) -> DataFrame:
    """The asked page of each query's hits by score, at most max_results of it. `rank` counts within the page.

    Without a page size a page has max_results hits. Pages beyond the last hit are empty, however far.
    """
    if isinstance(pageno, int) and isinstance(max_results, int):
        size = max(max_results, 0) if page_size is None else page_size
        before = size * (max(pageno, 1) - 1)
        last = before + max(min(max_results, size), 0)
    else:
        shown = F.greatest(F.lit(max_results) if isinstance(max_results, int) else max_results, F.lit(0)).cast("long")
        size = shown if page_size is None else F.lit(page_size).cast("long")
        before = size * (F.greatest(F.lit(pageno) if isinstance(pageno, int) else pageno, F.lit(1)).cast("long") - 1)
        last = before + F.least(shown, size)
    order = [F.col("score").desc(), F.col(id_column)]
    ranked = top_k(hits, ["query_id"], order, last, [id_column])
    return ranked.where(F.col("rank") > before).withColumn("rank", (F.col("rank") - before).cast("int"))


def top_hit(hits: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The first hit per query, as `page_results` orders them (equal ones by their other columns). Each task sends one row per query."""
    rest = [name for name in hits.columns if name not in ("query_id", "score", id_column)]
    order = [F.col("score").desc(), F.col(id_column), *map(F.col, rest)]
    first = top_k(hits, ["query_id"], order, 1, [id_column], rank="_rank")
    return first.select("query_id", id_column, "score", *rest)


def result_counts(queries: DataFrame, hits: DataFrame, max_results: int = settings.DEFAULT_RESULTS_LIMIT) -> DataFrame:
    """Total and shown hits per query; queries without hits stay, with a message."""
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    total = F.coalesce("total", F.lit(0))
    return queries.join(counted, "query_id", "left").select(
        "query_id",
        "query",
        total.alias("total"),
        F.least(total, F.lit(max_results)).alias("shown"),
        F.when(total == 0, F.lit(settings.NO_RESULTS)).alias("message"),
    )


def unresponsive_engines(requested: DataFrame, hits: DataFrame) -> DataFrame:
    """Requested (query_id, engine) pairs without any hit."""
    answered = hits.select("query_id", "engine").distinct()
    return requested.select("query_id", "engine").join(answered, ["query_id", "engine"], "left_anti")


class Search(NamedTuple):
    """hits: the asked page per request; counts: hits in all and shown; rejected: bad requests."""

    hits: DataFrame
    counts: DataFrame
    rejected: DataFrame


def search(requests: DataFrame, docs: DataFrame, page_size: int | None = None, now: Column | None = None) -> Search:
    """Requests from their raw columns to a page of ranked hits each.

    Requests: query_id, query, categories, engines, language, time_range, pageno,
    max_results. Documents: doc_id, text, engine, language, categories, ts. Texts are
    read for words once; after that only ids move until the shown rows get their text.
    """
    good, rejected = split_valid(validate_requests(normalise_requests(requests), "search"))
    ranked = rank_bm25(docs.select("doc_id", "text"), good.select("query_id", "query"))
    facts = docs.select("doc_id", "engine", "language", "categories", "ts")
    wanted = ["engines", "categories", "language", "time_range"]
    options = good.select("query_id", "pageno", "max_results", *(F.col(name).alias(f"wanted_{name}") for name in wanted))
    matched = skew_join(ranked, facts, ["doc_id"], "inner", ["query_id"])
    fitting = lookup_join(matched, options, ["query_id"], "inner", ["doc_id"]).where(fits_request(now))
    kept = materialize(fitting.select("query_id", "doc_id", "score", "pageno", "max_results"), "hits")
    paged = page_results(kept, F.col("pageno"), page_size, F.col("max_results")).select("query_id", "doc_id", "score", "rank")
    hits = lookup_join(docs, paged, ["doc_id"], "inner", ["doc_id"])
    totals = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    shown = paged.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    counts = (
        good.select("query_id", "query")
        .join(totals, "query_id", "left")
        .join(shown, "query_id", "left")
        .na.fill(0, ["total", "shown"])
        .withColumn("message", F.when(F.col("shown") == 0, F.lit(settings.NO_RESULTS)))
    )
    return Search(hits, counts, rejected)


def fits_request(now: Column | None) -> Column:
    """Whether a document fits the options beside it; engines, when named, override categories."""
    engines, categories = F.col("wanted_engines"), F.col("wanted_categories")
    now = F.current_timestamp() if now is None else now
    oldest = F.lit(None)
    for word in settings.TIME_RANGES:
        oldest = F.when(F.col("wanted_time_range") == word, now - F.expr(f"INTERVAL 1 {word}")).otherwise(oldest)
    return (
        F.when(engines.isNotNull(), F.array_contains(engines, F.col("engine")))
        .when(categories.isNotNull(), F.arrays_overlap(categories, F.col("categories")))
        .otherwise(F.lit(True))
        & (F.col("language") == F.col("wanted_language"))
        & (oldest.isNull() | (F.col("ts") >= oldest))
    )


def numbered_entry() -> Column:
    content = F.coalesce("content", F.lit(""))
    return F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("N/A")),
        F.lit("\n   URL: "), F.coalesce("url", F.lit("N/A")),
        F.lit("\n   Engine: "), F.coalesce("engine", F.lit("N/A")),
        F.lit("\n   Content: "), snippet(content, settings.MAX_SNIPPET), F.lit("\n"),
    )


def simple_entry() -> Column:
    content = F.coalesce("content", F.lit("N/A"))
    return F.concat(
        F.lit("Title: "), F.coalesce("title", F.lit("N/A")),
        F.lit("\nURL: "), F.coalesce("url", F.lit("N/A")),
        F.lit("\nContent: "), snippet(content, settings.SIMPLE_SNIPPET),
        F.lit("\n" + "-" * 50),
    )


def pretty_entry() -> Column:
    content = F.coalesce("content", F.lit(""))
    shown = F.concat(F.lit("   Content: "), snippet(content, settings.PRETTY_SNIPPET), F.lit("\n"))
    return F.concat(
        F.lit("\n"), F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("N/A")),
        F.lit("\n   URL: "), F.coalesce("url", F.lit("N/A")),
        F.lit("\n   Engine: "), F.coalesce("engine", F.lit("N/A")),
        F.lit("\n"), F.when(content != "", shown).otherwise(F.lit("")), F.lit("-" * 40),
    )


# The fields of a hit in JSON, as far as the page has them.
HIT_FIELDS = ["url", "title", "content", "engine", "parsed_url", "template", "engines", "positions", "score"]
# The other parts of a response in JSON, as far as the queries have them.
RESPONSE_PARTS = ["answers", "corrections", "infoboxes", "suggestions", "unresponsive_engines"]


def json_entry(columns: list[str]) -> Column:
    """All fields of a hit; null fields stay."""
    return F.to_json(F.struct(*[name for name in HIT_FIELDS if name in columns]), {"ignoreNullFields": "false"})


def json_parts(columns: list[str]) -> Column:
    """The response's other parts, each after a comma."""
    printed = lambda name: F.to_json(F.struct(name), {"ignoreNullFields": "false"})
    inside = [F.concat(F.lit(","), F.substring(printed(name), F.lit(2), F.length(printed(name)) - 2)) for name in RESPONSE_PARTS if name in columns]
    return F.concat(F.lit(""), *inside)


def render_results(queries: DataFrame, paged: DataFrame, mode: str) -> DataFrame:
    """One text per query from a page of hits (`rank` from 1, `total` hits in all).

    Modes: simple, pretty, numbered, json. `queries` has query_id, query and total;
    `paged` comes from `page_results`, so a query holds no more rows than its page. In JSON
    the hits have all fields of `paged` and the response all parts of `queries`. A query
    with an `error` shows that and nothing else.
    """
    entry = json_entry(paged.columns) if mode == "json" else {"simple": simple_entry, "pretty": pretty_entry, "numbered": numbered_entry}[mode]()
    lines = paged.select("query_id", "rank", entry.alias("entry"))
    grouped = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("entries"))
    rows = queries.join(grouped, "query_id", "left")
    entries = F.coalesce(F.col("entries.entry"), F.array().cast("array<string>"))
    shown, total = F.size(entries).cast("string"), F.col("total").cast("string")
    text = {
        "simple": F.array_join(entries, "\n"),
        "pretty": F.concat_ws(
            "\n",
            F.concat(F.lit("Query: "), F.coalesce("query", F.lit("N/A"))),
            F.concat(F.lit("Number of results: "), shown),
            # The label is part of the format although the number is the hit total.
            F.concat(F.lit("Search time: "), total, F.lit(" results")),
            F.lit("=" * 60),
            F.when(F.size(entries) > 0, F.array_join(entries, "\n")),
        ),
        "numbered": F.when(F.size(entries) == 0, F.lit(settings.NO_RESULTS)).otherwise(
            F.concat(
                F.lit("Search results for '"), F.col("query"), F.lit("' (showing "), shown,
                F.lit(" of "), F.col("total").cast("string"), F.lit(" results):\n\n"), F.array_join(entries, "\n"),
            )
        ),
        "json": F.concat(
            F.lit('{"query":'), F.to_json(F.struct("query")).substr(F.lit(10), F.length(F.to_json(F.struct("query"))) - 10),
            F.lit(',"number_of_results":'), total, F.lit(',"results":['), F.array_join(entries, ","), F.lit("]"), json_parts(queries.columns), F.lit("}"),
        ),
    }[mode]
    if "error" in queries.columns:
        prefix = settings.SEARCH_ERROR if mode == "numbered" else settings.RESPONSE_ERROR
        text = F.when(F.col("error").isNotNull(), F.concat(F.lit(prefix), F.col("error"))).otherwise(text)
    return rows.select("query_id", text.alias("report"))
