"""Request tables: defaults, clamps, checks, content guards, result filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake import settings
from pagelake.functions.text import (
    SCRIPT_SPACE,
    as_array,
    is_blank,
    json_string_bytes,
    trim_script,
    utf16_length,
)


def comma_list(text: Column) -> Column:
    """`a, b` -> [a,  b], untrimmed; empty and null give null."""
    return F.when(text != "", F.split(text, ",", -1))


def normalise_requests(
    requests: DataFrame,
    most_results: int | None = settings.MAX_RESULTS_LIMIT,
    most_subpages: int | None = settings.MAX_SUBPAGE_LIMIT,
    most_content: int | None = settings.MAX_FETCH_CONTENT,
) -> DataFrame:
    """Defaults and limits for whichever request columns the table has. A limit of None lifts it."""

    def capped(value: Column, most: int | None) -> Column:
        return value if most is None else F.least(value, F.lit(most))

    rules = {
        "language": lambda c: F.coalesce(c, F.lit(settings.DEFAULT_LANGUAGE)),
        "pageno": lambda c: F.greatest(F.coalesce(c, F.lit(settings.DEFAULT_PAGENO)), F.lit(1)),
        "max_results": lambda c: capped(F.coalesce(c, F.lit(settings.DEFAULT_RESULTS_LIMIT)), most_results),
        "subpage_limit": lambda c: capped(F.coalesce(c, F.lit(settings.DEFAULT_SUBPAGE_LIMIT)), most_subpages),
        # `least` skips nulls, and no limit must stay no limit.
        "max_content_length": lambda c: F.when(c.isNotNull(), capped(c, most_content)),
        "categories": comma_list,
        "engines": comma_list,
    }
    return requests.withColumns({name: rule(F.col(name)) for name, rule in rules.items() if name in requests.columns})


def with_first_failure(df: DataFrame, rules: list[tuple[Column, int, str]]) -> DataFrame:
    """Adds status and error of the first rule that fails; 200 and null if none does.

    The rules are evaluated once, to the number of the failed one.
    """
    number = F.lit(0)
    for i, (failed, _, _) in reversed(list(enumerate(rules, 1))):
        number = F.when(F.coalesce(failed, F.lit(False)), F.lit(i)).otherwise(number)
    status, error = F.lit(200), F.lit(None).cast("string")
    for i, (_, code, message) in enumerate(rules, 1):
        status = F.when(F.col("_rule") == i, F.lit(code)).otherwise(status)
        error = F.when(F.col("_rule") == i, F.lit(message)).otherwise(error)
    return df.withColumn("_rule", number).withColumns({"status": status, "error": error}).drop("_rule")


def is_missing(column: Column) -> Column:
    return column.isNull() | (column == "")


def option_rules(columns: list[str]) -> list:
    """Rules for content_format and validation_mode, where the table has them."""
    rules = []
    if "content_format" in columns:
        rules.append((~parsed_format(F.col("content_format")).isin(*settings.CONTENT_FORMATS), 400, settings.FORMAT_INVALID))
    if "validation_mode" in columns:
        rules.append((~parsed_mode(F.col("validation_mode")).isin(*settings.VALIDATION_MODES), 400, settings.MODE_INVALID))
    return rules


def parsed_format(raw: Column) -> Column:
    return F.coalesce(F.lower(raw), F.lit(settings.DEFAULT_CONTENT_FORMAT))


def parsed_mode(raw: Column) -> Column:
    word = F.lower(trim_script(raw))
    return F.when(F.coalesce(word, F.lit("")) == "", F.lit(settings.DEFAULT_VALIDATION_MODE)).otherwise(word)


def request_options(requests: DataFrame) -> DataFrame:
    """Lower-cased, defaulted content_format and validation_mode with their status and error."""
    return with_first_failure(requests, option_rules(requests.columns)).withColumns(
        {
            "content_format": parsed_format(F.col("content_format")),
            "validation_mode": parsed_mode(F.col("validation_mode")),
        }
    )


def schema_rules(schema: Column) -> list:
    """A JSON Schema must be there and be an object; malformed text is not one."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(schema)).startswith("OBJECT<"), F.lit(False))
    return [
        (schema.isNull() | (F.trim(schema) == "null"), 400, settings.SCHEMA_REQUIRED),
        (~is_object, 400, settings.SCHEMA_TYPE),
    ]


def request_rules(kind: str, columns: list[str]) -> list:
    """The checks of a request kind, in the order that decides which error wins."""
    if kind == "search":
        word = F.col("time_range")
        return [
            (is_missing(F.col("query")), 400, settings.QUERY_REQUIRED),
            (~is_missing(word) & ~word.isin(*settings.TIME_RANGES), 400, settings.TIME_RANGE_INVALID),
        ]
    if kind in ("fetch", "crawl"):
        return [(is_missing(F.col("url")), 400, settings.URL_REQUIRED)]
    if kind == "extract":
        return [
            (is_missing(F.col("url")), 400, "Error: " + settings.URL_REQUIRED),
            *schema_rules(F.col("json_schema")),
            *option_rules(columns),
        ]
    raise ValueError(f"unknown request kind: {kind}")


def validate_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Adds `status` and `error` (null when good). No row is dropped."""
    return with_first_failure(requests, request_rules(kind, requests.columns))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine)."""
    return checked.where(F.col("error").isNull()), checked.where(F.col("error").isNotNull())


BODY_FIELDS = {"url": "source_url", "prompt": "prompt", "validation_mode": "validation_mode"}
FIXED_BODY = '{"content": "", "json_schema": , "content_format": "txt"}'


def side_bytes(columns: list[str]) -> Column:
    """Bytes that a request's url, prompt and mode add to the body that carries the content."""
    size = F.lit(0)
    for name in BODY_FIELDS:
        if name in columns:
            # , "name": "value"
            added = json_string_bytes(F.col(name)) + len(BODY_FIELDS[name]) + 8
            size = size + F.when(F.col(name).isNull(), 0).otherwise(added)
    return size


def with_content_facts(contents: DataFrame, most_side_bytes: Column, max_body: int, schema_bytes: int) -> DataFrame:
    """Adds what the guards and the key need of a content, so that the content itself can stay behind.

    `_bytes` is the content's size in a JSON body. It is worked out exactly only where
    six bytes for every unit, beside the largest side fields, might not fit.
    """
    content = F.col("content")
    fits = F.col("_units") * 6 + most_side_bytes + len(FIXED_BODY) + schema_bytes <= max_body
    return contents.withColumn("_units", utf16_length(content)).withColumns(
        {
            "_length": F.length(content),
            "_blank": content.isNull() | is_blank(content),
            "_script_blank": is_blank(content, SCRIPT_SPACE),
            "_bytes": F.when(fits, F.col("_units") * 6).otherwise(json_string_bytes(content)),
            "_hash": F.sha2(content, 256),
        }
    )


def content_rules(side: Column, max_length: int, max_body: int, schema_bytes: int) -> list:
    """The guards over `with_content_facts`, in the order in which they are applied."""
    body = F.col("_bytes") + side + len(FIXED_BODY) + schema_bytes
    return [
        (F.col("_blank"), 400, settings.CONTENT_EMPTY),
        (F.col("_length") > max_length, 413, settings.CONTENT_TOO_LONG.format(limit=max_length)),
        (body > max_body, 413, settings.BODY_TOO_LARGE.format(limit=max_body)),
        (F.col("_script_blank"), 400, settings.SIDECAR_EMPTY),
        (F.col("_units") > max_length, 413, settings.SIDECAR_TOO_LONG.format(limit=max_length)),
    ]


def guard_content(
    pages: DataFrame,
    max_length: int = settings.EXTRACT_MAX_LENGTH,
    max_body: int = settings.EXTRACT_MAX_BODY_BYTES,
    schema_bytes: int = 2,
) -> DataFrame:
    """Status and error of page content on its way to extraction.

    `schema_bytes` is the size of the JSON schema that travels with the content; the
    columns url, prompt and validation_mode count where they exist.
    """
    side = side_bytes(pages.columns)
    facts = with_content_facts(pages, side, max_body, schema_bytes)
    return with_first_failure(facts, content_rules(side, max_length, max_body, schema_bytes)).select(*pages.columns, "status", "error")


def filter_results(
    results: DataFrame,
    categories: list[str] | None = None,
    engines: list[str] | None = None,
    language: str | None = None,
    time_range: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Keep results that fit a request. Engines, when named, override categories."""
    if engines:
        results = results.where(F.col("engine").isin(*engines))
    elif categories:
        results = results.where(F.arrays_overlap("categories", as_array(categories)))
    if language:
        results = results.where(F.col("language") == language)
    if time_range:
        if time_range not in settings.TIME_RANGES:
            raise ValueError(settings.TIME_RANGE_INVALID)
        oldest = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL 1 {time_range}")
        results = results.where(F.col("ts") >= oldest)
    return results


def project_hits(hits: DataFrame, content_default: str = "") -> DataFrame:
    """Text to show for missing fields: `N/A`, and empty (or `N/A`) for content."""
    shown = {name: F.coalesce(F.col(name), F.lit("N/A")) for name in ("title", "url", "engine")}
    return hits.withColumns({**shown, "content": F.coalesce(F.col("content"), F.lit(content_default))})
