"""Column functions over page and result text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake import settings

# White space as Python's strip and JavaScript's trim see it.
PYTHON_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SCRIPT_SPACE = r"\t-\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def is_blank(text: Column, space: str = PYTHON_SPACE) -> Column:
    """Empty or white space only."""
    return ~text.rlike(f"[^{space}]")


def trim_script(text: Column) -> Column:
    """Trim with JavaScript's white space."""
    return F.regexp_replace(text, f"^[{SCRIPT_SPACE}]+|[{SCRIPT_SPACE}]+$", "")


def first_chars(text: Column, n) -> Column:
    """The first n code points; n is a number or a column."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(text, F.lit(1), n.cast("int"))


def cut_with_suffix(text: Column, n, suffix: str) -> Column:
    """First n characters and a suffix where the text is longer, else the text."""
    return F.when(F.length(text) > n, F.concat(first_chars(text, n), F.lit(suffix))).otherwise(text)


def snippet(text: Column, n: int) -> Column:
    return cut_with_suffix(text, n, "...")


def truncate_content(text: Column, n) -> Column:
    """Cut page text to n characters but keep its links section whole. Null n keeps all."""
    n = F.lit(n).cast("int") if n is None or isinstance(n, int) else n
    marker_at = F.locate(settings.LINKS_MARKER, text)
    main = first_chars(text, marker_at - 1)
    section = F.substring(text, marker_at, F.length(text))
    return (
        F.when(n.isNull() | (F.length(text) <= n), text)
        .when(
            marker_at > 0,
            F.concat(cut_with_suffix(main, n, settings.TRUNCATED_SUFFIX), section),
        )
        .otherwise(F.concat(first_chars(text, n), F.lit(settings.TRUNCATED_SUFFIX)))
    )


def links_section(links: Column) -> Column:
    """The text block that lists a page's links; empty when there are none."""
    lines = F.transform(links, lambda link: F.concat(link["anchor_text"], F.lit(": "), link["url"]))
    return F.when(
        F.size(links) > 0,
        F.concat(F.lit(settings.LINKS_MARKER + "\n"), F.array_join(lines, "\n")),
    ).otherwise(F.lit(""))


def url_parts(url: Column) -> Column:
    """[scheme, host, path]; parts a url lacks are empty strings."""
    return F.array(
        *(
            F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))
            for part in ("PROTOCOL", "HOST", "PATH")
        )
    )


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; characters past the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def json_string_bytes(text: Column) -> Column:
    """Bytes of the text as an ASCII-only JSON string, without its quotes."""
    plain = F.length(F.regexp_replace(text, r"[^ -~]+", ""))
    marks = F.length(F.regexp_replace(text, r'[^"\\]+', ""))
    short_controls = F.length(F.regexp_replace(text, r"[^\n\r\t\f\x08]+", ""))
    units = utf16_length(text)
    return plain + marks + 2 * short_controls + 6 * (units - plain - short_controls)


def humanize_key(key: Column) -> Column:
    """`team_name` -> `Team Name`."""
    spaced = F.regexp_replace(key, r"[_\-]+", " ")
    words = F.filter(F.split(spaced, f"[{PYTHON_SPACE}]+"), lambda word: word != "")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))),
        ),
        " ",
    )


def redact(text: Column, secrets) -> Column:
    """Replace every secret of more than four characters, as a literal."""
    for secret in secrets:
        if secret and len(secret) > 4:
            text = F.replace(text, F.lit(secret), F.lit(settings.REDACTED))
    return text


def as_array(values) -> Column:
    """A string array column from a Python list; columns pass through."""
    if isinstance(values, Column):
        return values
    if values is None:
        return F.lit(None).cast("array<string>")
    return F.array(*(F.lit(value) for value in values)).cast("array<string>")
