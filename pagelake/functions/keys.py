"""Content-addressed keys of extraction results."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake import settings


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every depth and one way to write each number; null if malformed."""
    return F.to_json(F.try_parse_json(text))


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def extraction_key(
    content: Column | None,
    schema: dict | Column,
    mode: Column | str = settings.DEFAULT_VALIDATION_MODE,
    model: Column | str = "rules",
    prompt: Column | str | None = None,
    content_format: Column | str = settings.DEFAULT_CONTENT_FORMAT,
    context: Column | None = None,
    content_hash: Column | None = None,
) -> Column:
    """Hex sha256 over everything that decides a result. The url is not part of it, so
    equal text at two urls shares one result. The content may be given by its sha256.

    Null model, mode, prompt, format and context count as empty. Without content, or with a
    malformed schema or context, there is no key (null)."""
    schema_text = schema if isinstance(schema, Column) else F.lit(json.dumps(schema, ensure_ascii=False))
    nothing = F.lit("")
    given = lambda value: F.coalesce(_text(value), nothing)
    parts = [
        F.lit(str(settings.CACHE_KEY_VERSION)),
        given(model),
        given(mode),
        canonical_json(schema_text),
        nothing if prompt is None else given(prompt),
        given(content_format),
        nothing if context is None else F.when(context.isNull(), nothing).otherwise(canonical_json(context)),
        F.sha2(content, 256) if content_hash is None else content_hash,
    ]
    # One null part makes the whole null, so parts never shift.
    joined = [piece for part in parts for piece in (part, F.lit("\0"))][:-1]
    return F.sha2(F.concat(*joined), 256)
