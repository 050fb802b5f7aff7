"""Raw responses to text, and search responses to tables."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Content encodings, default charset, first bytes of a gzip body.
GZIP_NAMES = ("gzip", "x-gzip")
DEFLATE_NAME = "deflate"
DEFAULT_CHARSET = "utf-8"
GZIP_MAGIC = b"\x1f\x8b"
# The end of a stored response in a bundle: the record separator of JSON text sequences (RFC 7464).
RECORD_END = "\x1e"

HIT = (
    "struct<url:string,title:string,content:string,engine:string,parsed_url:array<string>,template:string,"
    "engines:array<string>,positions:array<int>,score:double>"
)
# The parts of a search response and their row types.
PARTS = {
    "results": f"array<{HIT}>",
    "answers": "array<struct<answer:string,type:string,engine:string>>",
    "corrections": "array<struct<correction:string,original:string>>",
    "infoboxes": "array<struct<infobox:string,content:string,engine:string>>",
    "suggestions": "array<string>",
    "unresponsive_engines": "array<string>",
}
ENVELOPE = ", ".join(
    ["query string", "number_of_results long", *(f"{name} {kind}" for name, kind in PARTS.items()), "error string", "_malformed string"]
)


def header(name: str, headers: str = "headers") -> Column:
    """A header by its name as written or in lower case; empty counts as absent."""
    values = F.col(headers)
    return F.coalesce(*(F.nullif(F.try_element_at(values, F.lit(spelling)), F.lit("")) for spelling in (name, name.lower())))


def decode_responses(responses: DataFrame, body: str = "body", headers: str = "headers") -> DataFrame:
    """Adds `text` and `error` to raw responses; the body goes no further.

    Inflates gzip (by header or first bytes) and deflate, then decodes by the charset of
    the content type. Headers are looked up in the JVM; the Arrow pass reads only body,
    encoding and charset. A body that cannot be read gives an error row.
    """
    encoding = F.lower(F.trim(F.split(header("Content-Encoding", headers), ",")[0]))
    charset = F.regexp_extract(header("Content-Type", headers), r"(?i)charset=([^\s;]+)", 1)
    charset = F.regexp_replace(charset, "^[\"']+|[\"']+$", "")
    prepared = responses.withColumns({"_encoding": encoding, "_charset": F.nullif(charset, F.lit(""))})
    kept = [name for name in responses.columns if name != body]
    schema = T.StructType([responses.schema[name] for name in kept] + [T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def decode_batches(batches):
        for batch in batches:
            texts, errors = [], []
            columns = (batch.column(name).to_pylist() for name in (body, "_encoding", "_charset"))
            for raw, coding, charset in zip(*columns):
                text = error = None
                try:
                    text = read_body(raw or b"", coding).decode(charset or DEFAULT_CHARSET)
                    text.encode()  # some charsets yield text that UTF-8 cannot hold
                except (OSError, EOFError, zlib.error, UnicodeError, LookupError) as problem:
                    text, error = None, str(problem)
                texts.append(text)
                errors.append(error)
            arrays = [batch.column(name) for name in kept] + [pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "text", "error"])

    return prepared.mapInArrow(decode_batches, schema)


def pages_from_responses(raw: DataFrame, body: str = "body", headers: str = "headers") -> DataFrame:
    """Raw responses (url, body, headers, status_code and others) as a page table for fetch, crawl and extract.

    The page's html is the decoded body; a body that cannot be decoded leaves a page without html.
    """
    return decode_responses(raw, body, headers).withColumnRenamed("text", "html").drop("error")


def read_body(raw: bytes, encoding: str | None) -> bytes:
    if encoding in GZIP_NAMES or raw.startswith(GZIP_MAGIC):
        return gzip.decompress(raw)
    if encoding == DEFLATE_NAME:
        return zlib.decompress(raw)
    return raw


def parse_envelopes(df: DataFrame, json_column: str) -> DataFrame:
    """Search responses as JSON text to typed columns; malformed ones become error rows."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    kept = [name for name in df.columns if name != json_column]
    parsed = df.select(*kept, F.from_json(json_column, ENVELOPE, options).alias("_envelope"), json_column)
    malformed = F.col("_envelope").isNull() | F.col("_envelope._malformed").isNotNull()
    error = F.when(malformed, F.lit("malformed JSON")).otherwise(F.col("_envelope.error"))
    columns = [F.col(f"_envelope.{name}") for name in ("query", "number_of_results", *PARTS)]
    return parsed.select(*kept, *columns, error.alias("error"))


def read_search_responses(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Stored search responses with the file they came from: one JSON document per line, or,
    with `one_per_file`, one per file, however it is indented. The driver lists every file: many responses belong in bundles."""
    texts = spark.read.text(path, wholetext=one_per_file).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_envelopes(texts, "value")


def write_response_bundles(responses: DataFrame, path: str) -> None:
    """Store responses (name, value), however indented, many to a file: each is its name, a line feed and its text,
    and RECORD_END, which JSON text escapes. A million responses are as many files as there are tasks."""
    record = F.concat(F.coalesce(F.col("name").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("value", F.lit("")))
    responses.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def read_response_bundles(spark: SparkSession, path: str) -> DataFrame:
    """What `write_response_bundles` stored, parsed, with the response's name; files are split over tasks between responses."""
    records = spark.read.text(path, lineSep=RECORD_END)
    name = F.substring_index("value", "\n", 1)
    text = F.substring("value", F.length(name) + 2, F.length("value"))
    return parse_envelopes(records.select(F.nullif(name, F.lit("")).alias("name"), text.alias("value")), "value")


def explode_envelope(envelopes: DataFrame, part: str, keep: list[str] = ("query",)) -> DataFrame:
    """One row per element of a part with its position from 1; responses without any keep a null row."""
    exploded = envelopes.select(*keep, F.posexplode_outer(part).alias("_pos", "_item"))
    position = (F.col("_pos") + 1).alias("position")
    if part in ("suggestions", "unresponsive_engines"):
        return exploded.select(*keep, position, F.col("_item").alias("value"))
    return exploded.select(*keep, position, "_item.*")
