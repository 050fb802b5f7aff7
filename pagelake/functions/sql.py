"""SQL names for column functions, and page links as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagelake import settings
from pagelake.functions.page_reader import read_page


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


MARKER, SUFFIX = literal(settings.LINKS_MARKER), literal(settings.TRUNCATED_SUFFIX)

# SQL functions with an expression body are inlined by the optimizer.
SQL_FUNCTIONS = {
    "snippet(content STRING, n INT) RETURNS STRING": "if(length(content) > n, concat(substring(content, 1, n), '...'), content)",
    "truncate_content(content STRING, n INT) RETURNS STRING": f"""CASE
      WHEN n IS NULL OR length(content) <= n THEN content
      WHEN locate({MARKER}, content) > 0 THEN concat(
        if(locate({MARKER}, content) - 1 > n, concat(substring(content, 1, n), {SUFFIX}), substring(content, 1, locate({MARKER}, content) - 1)),
        substring(content, locate({MARKER}, content)))
      ELSE concat(substring(content, 1, n), {SUFFIX}) END""",
    "url_parts(url STRING) RETURNS ARRAY<STRING>": """array(coalesce(try_parse_url(url, 'PROTOCOL'), ''),
      coalesce(try_parse_url(url, 'HOST'), ''), coalesce(try_parse_url(url, 'PATH'), ''))""",
    "extraction_key(content STRING, json_schema STRING, mode STRING, model STRING, prompt STRING) RETURNS STRING": f"""sha2(concat(
      '{settings.CACHE_KEY_VERSION}', chr(0), coalesce(model, ''), chr(0), coalesce(mode, ''), chr(0), to_json(try_parse_json(json_schema)), chr(0),
      coalesce(prompt, ''), chr(0), '{settings.DEFAULT_CONTENT_FORMAT}', chr(0), '', chr(0), sha2(content, 256)), 256)""",
}


@udtf(returnType="pos INT, anchor_text STRING, href STRING, url STRING", useArrow=True)
class PageLinks:
    def eval(self, html: str, url: str):
        for link in read_page(url, html).get("links") or []:
            yield link["pos"], link["anchor_text"], link["href"], link["url"]


def register(spark: SparkSession) -> None:
    """Temporary functions for this session: the SQL functions and `page_links(html, url)`."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("page_links", PageLinks)
