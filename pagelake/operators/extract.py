"""Page text to checked records, with a cache keyed by content."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake import settings
from pagelake.functions.keys import extraction_key
from pagelake.functions.text import first_chars, redact
from pagelake.operators.cache import cache_entries, look_up
from pagelake.operators.fetch import pages_at
from pagelake.operators.requests import (
    content_rules,
    is_missing,
    parsed_format,
    parsed_mode,
    schema_rules,
    side_bytes,
    with_content_facts,
    with_first_failure,
)
from pagelake.operators.schema_table import check_records, compile_schemas
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import fits, keep_listed, lookup_join, skew_join
from pagelake.sources.page_store import PageStore

# Takes rows with content, title, heading, links, prompt, json_schema and max_input_tokens and adds `record`, a
# JSON text; may add input_tokens and output_tokens. Other columns must stay.
Extractor = Callable[[DataFrame], DataFrame]

# A token cap keeps so many characters of the text per token.
CHARS_PER_TOKEN = 4
RESULT_COLUMNS = ["status", "stage", "error", "data", "cached", "input_tokens", "output_tokens"]


class Extraction(NamedTuple):
    """results: one row per request; new_entries: rows to store in the cache."""

    results: DataFrame
    new_entries: DataFrame


def rule_extractor(rules: dict) -> Extractor:
    """An extractor from rules per field: `title`, `heading`, `links` (urls), or (pattern, group).

    It stands where a model call would; any other function of the same shape may.
    """

    def field(rule) -> Column:
        if rule in ("title", "heading"):
            return F.col(rule)
        if rule == "links":
            return F.col("links.url")
        pattern, group = rule
        return F.nullif(F.regexp_extract("content", pattern, group), F.lit(""))

    def run(pages: DataFrame) -> DataFrame:
        record = F.struct(*(field(rule).alias(name) for name, rule in rules.items()))
        return pages.withColumn("record", F.to_json(record, {"ignoreNullFields": "false"}))

    return run


def extract(
    requests: DataFrame,
    pages: DataFrame | PageStore,
    schema: dict | None,
    extractor: Extractor,
    cache: DataFrame,
    now: Column,
    mode: str = settings.DEFAULT_VALIDATION_MODE,
    model: str = "rules",
    prompt: str | None = None,
    ttl_seconds: int = settings.CACHE_TTL_SECONDS,
    max_length: int = settings.EXTRACT_MAX_LENGTH,
    max_body: int = settings.EXTRACT_MAX_BODY_BYTES,
    secrets: tuple[str, ...] = (),
) -> Extraction:
    """One result row per request (request_id, url, prompt?, validation_mode?, json_schema?,
    content?, content_format?, extraction_context?, max_input_tokens?).

    Without `schema` each request has its own in `json_schema`. A request with `content` is
    worked on that text, any other on the page at its url; the result has every request
    column but the content. Order of work: url, schema, fetch, guards, options, cache, schema
    compiler, extractor, check. Requests that ask the same of a text are one task; tasks that
    come to the same key are extracted once. Texts are read for their hashes and sizes, which alone meet
    the tasks and the cache; they are written for the extractor for missed keys only. Schemas are rows,
    compiled beside the data, as many as there are.

    `max_input_tokens` caps what the extractor sees of a text. It is no part of the key, so of
    the requests of one key the loosest cap holds; null and not finite numbers are none.
    """
    given = {
        "prompt": F.lit(prompt).cast("string"), "validation_mode": F.lit(mode), "content": F.lit(None).cast("string"),
        "content_format": F.lit(settings.DEFAULT_CONTENT_FORMAT), "extraction_context": F.lit(None).cast("string"),
        "max_input_tokens": F.lit(None).cast("double"),
    }
    own_schemas = schema is None
    asked = requests.withColumns({name: value for name, value in given.items() if name not in requests.columns})
    if not own_schemas:
        asked = asked.withColumn("json_schema", F.lit(json.dumps(schema)))
    source = F.when(F.col("content").isNotNull(), F.concat(F.lit("content "), F.sha2("content", 256)))
    asked = asked.withColumn("_source", source.when(~is_missing(F.col("url")), F.concat(F.lit("page "), F.col("url"))))
    cap = F.col("max_input_tokens").try_cast("double")
    asked = asked.withColumn("_cap", F.when(cap.isNull() | F.isnan(cap) | (F.abs(cap) == F.lit(float("inf"))), F.lit(None)).otherwise(cap))
    parts = ["_source", "url", "prompt", "validation_mode", "json_schema", "content_format", "extraction_context", "_cap"]
    asked = asked.withColumn("_task", F.sha2(F.to_json(F.struct(*parts)), 256))
    tasks = materialize(asked.where(F.col("_source").isNotNull()).select("_task", *parts).distinct(), "tasks")

    own_texts = asked.where(F.col("content").isNotNull()).select("_source", "content") if "content" in requests.columns else None

    def texts_of(sources: DataFrame) -> DataFrame:
        """The texts of the listed tasks (_source, url), one per source."""
        fetched = pages_at(pages, sources.where(F.col("_source").startswith("page ")).select("url").distinct())
        texts = fetched.withColumn("_source", F.concat(F.lit("page "), F.col("url")))
        texts = texts.select("_source", "content", "title", "heading", "links", "error")
        if own_texts is None:
            return texts
        listed = sources.where(F.col("_source").startswith("content ")).select("_source").distinct()
        return texts.unionByName(keep_listed(own_texts, listed, ["_source"]).dropDuplicates(["_source"]), allowMissingColumns=True)

    side, schema_bytes = side_bytes(parts), F.octet_length("json_schema")
    most = tasks.agg(F.coalesce(F.max(side), F.lit(0)).alias("side"), F.coalesce(F.max(schema_bytes), F.lit(0)).alias("schema")).first()
    facts = with_content_facts(texts_of(tasks), F.lit(most["side"]), max_body, most["schema"])
    facts = facts.select("_source", F.col("error").alias("_fetch_error"), "_units", "_length", "_blank", "_script_blank", "_bytes", "_hash")
    facts = materialize(facts, "content-facts")
    beside = skew_join(tasks, facts, ["_source"], "left", ["_task"])
    keyed = materialize(_judge(beside, own_schemas, model, content_rules(side, max_length, max_body, schema_bytes)), "keys")

    good = keyed.where(F.col("error").isNull())
    loosest = F.max(F.coalesce("_cap", F.lit(float("inf"))))
    one_task = good.groupBy("key").agg(F.min(F.struct("_source", "url", "prompt", "mode", "json_schema")).alias("task"), loosest.alias("_cap"))
    one_task = one_task.select("key", "task.*", F.when(F.col("_cap") < float("inf"), F.col("_cap")).alias("max_input_tokens"))
    looked = materialize(look_up(one_task.withColumn("ts", now.cast("timestamp")), cache), "looked-up")
    missed = looked.where("NOT hit").select("key", "_source", "url", "prompt", "mode", "json_schema", "max_input_tokens")
    fresh = _run(texts_of, missed, extractor, secrets)
    hits = looked.where("hit").select("key", F.lit(200).alias("status"), "data", F.lit(True).alias("cached"))
    per_key = fresh.unionByName(hits, allowMissingColumns=True)

    done = skew_join(good.select("_task", "key", "mode"), per_key, ["key"], "inner", ["_task"])
    done = done.withColumn("mode", F.when(F.col("data").isNotNull(), F.col("mode"))).drop("key")
    refused = keyed.where(F.col("error").isNotNull()).select("_task", "status", "stage", "error")
    outcomes = done.unionByName(refused, allowMissingColumns=True)
    kept = [name for name in requests.columns if name not in ("validation_mode", "content")]
    results = skew_join(asked.select(*dict.fromkeys([*kept, "_task", "_source"])), outcomes, ["_task"], "left", ["request_id"])
    absent = F.col("_source").isNull()
    results = results.withColumns(
        {
            "error": F.when(absent, F.lit("Error: " + settings.URL_REQUIRED)).otherwise(F.col("error")),
            "status": F.when(absent, 400).otherwise(F.col("status")),
        }
    )
    entries = cache_entries(fresh.select("key", "data"), now, ttl_seconds)
    return Extraction(results.select(*kept, *RESULT_COLUMNS, F.col("mode").alias("validation_mode")), entries)


def _judge(tasks: DataFrame, own_schemas: bool, model: str, guards: list) -> DataFrame:
    """Tasks beside the facts of their text: key of the good ones, status and error of the rest."""
    mode, content_format = parsed_mode(F.col("validation_mode")), parsed_format(F.col("content_format"))
    context = F.col("extraction_context")
    failed = F.col("_fetch_error").isNotNull() | F.col("_hash").isNull()
    checks = schema_rules(F.col("json_schema")) if own_schemas else []
    bad_schema = reduce(Column.__or__, [F.coalesce(rule, F.lit(False)) for rule, _, _ in checks], F.lit(False))
    rules = [
        *checks,
        (failed, 200, ""),
        *guards,
        (~content_format.isin(*settings.CONTENT_FORMATS), 400, settings.FORMAT_INVALID),
        (~mode.isin(*settings.VALIDATION_MODES), 400, settings.MODE_INVALID),
        (context.isNotNull() & F.try_parse_json(context).isNull(), 400, settings.CONTEXT_INVALID),
    ]
    fetch_error = F.concat(F.lit(settings.FETCH_ERROR), F.coalesce("_fetch_error", F.lit(settings.PAGE_NOT_FOUND)))
    key = extraction_key(None, F.col("json_schema"), mode, model, F.col("prompt"), content_format, context, content_hash=F.col("_hash"))
    judged = with_first_failure(tasks, rules)
    failed = failed & ~bad_schema
    return judged.select(
        "_task", "_source", "url", "prompt", mode.alias("mode"), "json_schema", "_cap", "status",
        F.when(failed, "fetch").alias("stage"),
        F.when(failed, fetch_error).otherwise(F.col("error")).alias("error"),
        F.when(~failed & F.col("error").isNull(), key).alias("key"),
    )


def _run(texts_of: Callable[[DataFrame], DataFrame], missed: DataFrame, extractor: Extractor, secrets: tuple[str, ...]) -> DataFrame:
    """Extract and check the missed keys: (key, status, error, data, cached, tokens)."""
    tokens = ["input_tokens", "output_tokens"]
    schemas = materialize(compile_schemas(missed.select("json_schema").distinct()), "schemas")
    told = lookup_join(missed, schemas.select("json_schema", "problem"), ["json_schema"], "inner", ["key"])
    bad = told.where(F.col("problem").isNotNull()).select(
        "key", F.lit(400).alias("status"), F.col("problem").alias("error"), F.lit(None).cast("string").alias("data"),
        F.lit(False).alias("cached"), *(F.lit(None).cast("long").alias(name) for name in tokens),
    )
    deepest = schemas.agg(F.max("depth")).first()[0]
    if deepest is None:
        return bad
    good = materialize(told.where(F.col("problem").isNull()).drop("problem"), "missed-keys")
    page = materialize(texts_of(good.select("_source", "url").distinct()).drop("error"), "contents")
    if fits(good):
        wanted = page.join(F.broadcast(good), "_source")
    else:
        wanted = skew_join(good, page, ["_source"], "inner", ["key"])
    cap = F.col("max_input_tokens")
    length = F.greatest(F.floor(cap * CHARS_PER_TOKEN), F.lit(0)).cast("int")
    extracted = extractor(wanted.withColumn("content", F.when(cap.isNull(), F.col("content")).otherwise(first_chars(F.col("content"), length))))
    counted = [F.col(name) if name in extracted.columns else F.lit(None).cast("long").alias(name) for name in tokens]
    extracted = materialize(extracted.select("key", "mode", "json_schema", "record", *counted), "extracted")
    ruled = lookup_join(extracted, schemas.select("json_schema", "rules"), ["json_schema"], "inner", ["key"])
    valid = F.col("valid")
    problem = redact(F.concat(F.lit(settings.EXTRACTION_FAILED), F.array_join("errors", "; ")), secrets)
    checked = check_records(ruled, "record", "rules", "mode", deepest).select(
        "key",
        F.when(valid, 200).otherwise(502).alias("status"),
        F.when(~valid, problem).alias("error"),
        "data",
        F.lit(False).alias("cached"),
        *tokens,
    )
    return checked.unionByName(bad)


def crawl_extract(subpages: DataFrame, pages: DataFrame | PageStore, schema: dict, extractor: Extractor, cache: DataFrame, now: Column, **options) -> Extraction:
    """The same schema over every subpage of a crawl (seed_id, pos, url)."""
    requests = subpages.select(F.concat_ws("/", "seed_id", "pos").alias("request_id"), "seed_id", "pos", "url")
    return extract(requests, pages, schema, extractor, cache, now, **options)


def extraction_report(results: DataFrame) -> DataFrame:
    """Counts, token sums and hit share by status and cached, with totals (null = all).

    `level` tells a total (1: per status, 3: overall) from a missing value (0).
    """
    return results.rollup("status", "cached").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("stage") == "fetch").alias("failed_fetches"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.avg(F.coalesce(F.col("cached"), F.lit(False)).cast("int")).alias("hit_share"),
    )


def redact_literals(df: DataFrame, column: str, secrets: list[str]) -> DataFrame:
    return df.withColumn(column, redact(F.col(column), secrets))
