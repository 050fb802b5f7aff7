"""Writers for results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; nulls are written and non-ASCII text stays as it is."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_results(df: DataFrame, path: str, fmt: str = "json", column: str = "report") -> None:
    """Write rows as JSON lines, or the rendered text of one column."""
    if fmt == "json":
        as_json(df).write.text(path)
    elif fmt == "text":
        df.select(F.col(column).alias("value")).write.text(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
