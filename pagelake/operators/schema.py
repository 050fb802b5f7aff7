"""A caller's JSON Schema (a subset) as a Spark field, and schemas from field lists.

The schema is a driver-side value; what it describes is checked by expressions that
`operators.records` builds from the field.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Keywords per kind of node, and error messages.
OBJECT_KEYWORDS = ("type", "properties", "required", "additionalProperties", "description")
ARRAY_KEYWORDS = ("type", "items", "description")
LEAF_KEYWORDS = ("type", "description")
NULLABLE_KEYWORD = 'JSON Schema keyword nullable is not supported in v1; use type: ["T", "null"] instead'
ADDITIONAL_PROPERTIES = "additionalProperties: true is not supported; omit or set to false for strict objects"
UNSUPPORTED_KEYWORD = "Unsupported JSON Schema keyword or property: {}"
UNSUPPORTED_TYPE = "Unsupported JSON Schema type: {}"
NOT_AN_OBJECT = "json_schema must be a JSON object"
NODE_NOT_AN_OBJECT = "Schema must be an object (at {})"
ITEMS_REQUIRED = "array type requires items (at {})"
TYPE_REQUIRED = "Missing or invalid type (at {})"
PROPERTIES_REQUIRED = "object type requires properties (at {})"
TYPE_LIST = 'type arrays must be exactly ["<type>", "null"] in v1'

LEAF_TYPES = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
}
PROMPT_KEY = "prompt"
NAME_GAPS = re.compile(r"[_\s-]+")


class SchemaError(ValueError):
    """The JSON Schema is outside the supported subset."""


def compile_schema(schema: dict) -> T.StructField:
    """The JSON Schema as a field named `data`.

    `nullable` says that null is allowed; every property must be present all the same.
    """
    if _names_nullable(schema):
        raise SchemaError(NULLABLE_KEYWORD)
    if not isinstance(schema, dict):
        raise SchemaError(NOT_AN_OBJECT)
    return _field("data", schema, "$")


def _names_nullable(node) -> bool:
    if isinstance(node, list):
        return any(map(_names_nullable, node))
    return isinstance(node, dict) and ("nullable" in node or any(map(_names_nullable, node.values())))


def _field(name: str, node, at: str) -> T.StructField:
    if not isinstance(node, dict):
        raise SchemaError(NODE_NOT_AN_OBJECT.format(at))
    kind, nullable = _kind(node.get("type"), at)
    keywords = {"object": OBJECT_KEYWORDS, "array": ARRAY_KEYWORDS}.get(kind, LEAF_KEYWORDS)
    for keyword in node:
        if keyword not in keywords:
            raise SchemaError(f"{UNSUPPORTED_KEYWORD.format(keyword)} (at {at})")
    if kind == "object":
        data_type = _struct(node, at)
    elif kind == "array":
        if "items" not in node:
            raise SchemaError(ITEMS_REQUIRED.format(at))
        item = _field("item", node["items"], f"{at}.items")
        data_type = T.ArrayType(item.dataType, item.nullable)
    else:
        data_type = LEAF_TYPES[kind]
    description = node.get("description")
    metadata = {"description": description} if isinstance(description, str) and description else {}
    return T.StructField(name, data_type, nullable, metadata)


def _kind(declared, at: str) -> tuple[str, bool]:
    nullable = isinstance(declared, list)
    if nullable:
        named = [word for word in declared if word != "null"]
        if len(named) != 1 or len(named) == len(declared):
            raise SchemaError(f"{TYPE_LIST} (at {at})")
        declared = named[0]
    if not isinstance(declared, str):
        raise SchemaError(TYPE_REQUIRED.format(at))
    if declared not in ("object", "array") and declared not in LEAF_TYPES:
        raise SchemaError(f"{UNSUPPORTED_TYPE.format(declared)} (at {at})")
    return declared, nullable


def _struct(node: dict, at: str) -> T.StructType:
    extra = node.get("additionalProperties", False)
    if extra is True:
        raise SchemaError(ADDITIONAL_PROPERTIES)
    if extra is not False:
        raise SchemaError(f"{UNSUPPORTED_KEYWORD.format('additionalProperties')} (at {at})")
    properties = node.get("properties")
    if not isinstance(properties, dict):
        raise SchemaError(PROPERTIES_REQUIRED.format(at))
    required = node.get("required")
    required = required if isinstance(required, list) else []
    fields = []
    for name, child in properties.items():
        field = _field(name, child, f"{at}.properties.{name}")
        field.nullable = field.nullable or name not in required
        fields.append(field)
    return T.StructType(fields)


def humanize(key: str) -> str:
    """`team_name` -> `Team Name`."""
    return " ".join(map(str.capitalize, NAME_GAPS.sub(" ", key).split()))


def fields_schema(fields: str | dict, prompt: str | None = None) -> tuple[dict, str | None]:
    """(JSON Schema, prompt) from `"a, b"` or `{field: description}`; all strings, all required.

    A `prompt` entry of the dict is not a field; an explicit prompt wins over it.
    """
    if isinstance(fields, str):
        names = [name.strip() for name in fields.split(",") if name.strip()]
        if not names:
            raise ValueError("list at least one field name")
        fields = {name: humanize(name) for name in names}
        own_prompt = None
    else:
        fields = dict(fields)
        own_prompt = fields.pop(PROMPT_KEY, None)
        own_prompt = str(own_prompt) if own_prompt is not None and str(own_prompt).strip() else None
    if any(not isinstance(name, str) or not name.strip() for name in fields):
        raise ValueError("a field needs a name that is text")
    if not fields:
        raise ValueError("there is no field to extract")
    properties = {
        name: {"type": "string", "description": humanize(name) if text is None else str(text)} for name, text in fields.items()
    }
    schema = {"type": "object", "properties": properties, "required": list(fields)}
    return schema, (prompt or "").strip() or own_prompt
