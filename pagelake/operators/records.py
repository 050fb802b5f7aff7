"""Check JSON records against a compiled schema with column expressions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake import settings
from pagelake.functions.text import trim_script

LEADING_NUMBER = r"^-?\d+(?:\.\d+)?"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Doubles below this bound fit a 64-bit integer.
INTEGER_BOUND = float(2**63)


class Steps:
    """Columns worked out one after the other, so that no later expression repeats them.

    Values of a record are level 0, their JSON types and members level 1, typed values
    level 2. Inside array elements there are no columns, so expressions stay in place.
    """

    def __init__(self):
        self.levels: list[dict[str, Column]] = [{}, {}, {}]

    def keep(self, level: int, column: Column) -> Column:
        name = f"_step{level}_{len(self.levels[level])}"
        self.levels[level][name] = column
        return F.col(name)


class InPlace:
    def keep(self, level: int, column: Column) -> Column:
        return column


def validate_records(df: DataFrame, json_column: str, field: T.StructField, mode: str = settings.DEFAULT_VALIDATION_MODE) -> DataFrame:
    """Adds `data` (the typed record, null when invalid), `valid` and `errors`.

    Strict mode wants the exact JSON types. Coerce mode also takes numbers out of
    strings ("518 points" is 518). Null stays null and booleans are never numbers.
    """
    if mode not in settings.VALIDATION_MODES:
        raise ValueError(settings.MODE_INVALID)
    steps = Steps()
    record = Place(F.col("_record"), "$", F.lit("$"), mode == "coerce", steps)
    data, errors = _check(record, field.dataType, field.nullable)
    errors = F.when(F.col("_record").isNull(), F.array(F.lit("$: not valid JSON"))).otherwise(errors)
    checked = df.withColumn("_record", F.try_parse_json(json_column))
    for level in steps.levels:
        checked = checked.withColumns(level)
    checked = checked.withColumns({"errors": errors, "_data": data})
    valid = F.size("errors") == 0
    return checked.select(*df.columns, F.when(valid, F.col("_data")).alias("data"), valid.alias("valid"), "errors")


class Place(NamedTuple):
    """A spot in a record: the variant it is looked up in, by which path, and its printed path."""

    root: Column
    path: str
    shown: Column
    coerce: bool
    steps: Steps | InPlace

    def member(self, name: str, members: Column) -> Place:
        """A member by path; names that a path cannot spell are looked up in the members."""
        shown = F.concat(self.shown, F.lit("." + name))
        for quote in "'\"":
            if name and quote not in name and "?" not in name:
                return self._replace(path=f"{self.path}[{quote}{name}{quote}]", shown=shown)
        return Place(F.try_element_at(members, F.lit(name)), "$", shown, self.coerce, InPlace())

    def value(self) -> Column:
        return self.steps.keep(0, F.try_variant_get(self.root, self.path, "variant"))


def _check(place: Place, kind: T.DataType, nullable: bool, is_member: bool = False) -> tuple[Column, Column]:
    """(typed value, array of errors) at a place."""
    value = place.value()
    if isinstance(kind, T.StructType):
        data, errors = _check_object(place, value, kind)
    elif isinstance(kind, T.ArrayType):
        data, errors = _check_array(place, value, kind)
    else:
        data, name = _leaf(place, value, kind)
        errors = _error(data.isNull(), place, f"expected {name}")
    if nullable:
        errors = F.when(F.is_variant_null(value), _no_errors()).otherwise(errors)
    if is_member:
        errors = F.when(value.isNull(), F.array(F.concat(place.shown, F.lit(": missing")))).otherwise(errors)
    return data, errors


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _error(failed: Column, place: Place, message: str) -> Column:
    return F.when(failed, F.array(F.concat(place.shown, F.lit(": " + message)))).otherwise(_no_errors())


def _leaf(place: Place, value: Column, kind: T.DataType) -> tuple[Column, str]:
    """The leaf as its Spark type, or null where the JSON type does not fit."""
    json_type = place.steps.keep(1, F.coalesce(F.schema_of_variant(value), F.lit("MISSING")))
    if isinstance(kind, T.StringType):
        return place.steps.keep(2, F.when(json_type == "STRING", F.try_variant_get(value, "$", "string"))), "string"
    if isinstance(kind, T.BooleanType):
        return place.steps.keep(2, F.when(json_type == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))), "boolean"
    is_number = json_type.isin("BIGINT", "DOUBLE") | json_type.startswith("DECIMAL")
    number = F.when(is_number, F.try_variant_get(value, "$", "double"))
    if place.coerce:
        number = number.when(json_type == "STRING", numeric_text(F.try_variant_get(value, "$", "string")))
    if isinstance(kind, T.DoubleType):
        return place.steps.keep(2, number), "number"
    whole = F.when((number == F.floor(number)) & (F.abs(number) < INTEGER_BOUND), number.cast("long"))
    return place.steps.keep(2, F.when(json_type == "BIGINT", F.try_variant_get(value, "$", "long")).otherwise(whole)), "integer"


def numeric_text(text: Column) -> Column:
    """The number a string starts with, else the string as a plain number; blank is 0."""
    trimmed = trim_script(text)
    leading = F.regexp_extract(trimmed, LEADING_NUMBER, 0)
    return (
        F.when(leading != "", leading.try_cast("double"))
        .when(trimmed == "", F.lit(0.0))
        .when(trimmed.rlike(PLAIN_NUMBER), trimmed.try_cast("double"))
    )


def _check_object(place: Place, value: Column, kind: T.StructType) -> tuple[Column, Column]:
    members = place.steps.keep(1, value.try_cast("map<string,variant>"))
    names = F.array(*(F.lit(name) for name in kind.names)).cast("array<string>")
    parts = [_check(place.member(field.name, members), field.dataType, field.nullable, True) for field in kind.fields]
    extra = F.transform(
        F.array_sort(F.array_except(F.map_keys(members), names)), lambda name: F.concat(place.shown, F.lit("."), name, F.lit(": unexpected"))
    )
    is_object = members.isNotNull()
    values = [data.alias(name) for (data, _), name in zip(parts, kind.names)]
    return (
        F.when(is_object, F.struct(*values)),
        F.when(is_object, F.concat(*(errors for _, errors in parts), extra)).otherwise(
            F.array(F.concat(place.shown, F.lit(": expected object")))
        ),
    )


def _check_array(place: Place, value: Column, kind: T.ArrayType) -> tuple[Column, Column]:
    items = place.steps.keep(1, value.try_cast("array<variant>"))

    def item(part):
        def check(element, index):
            shown = F.concat(place.shown, F.lit("["), index.cast("string"), F.lit("]"))
            return _check(Place(element, "$", shown, place.coerce, InPlace()), kind.elementType, kind.containsNull)[part]

        return check

    is_array = items.isNotNull()
    return (
        F.when(is_array, F.transform(items, item(0))),
        F.when(is_array, F.flatten(F.transform(items, item(1)))).otherwise(
            F.array(F.concat(place.shown, F.lit(": expected array")))
        ),
    )
