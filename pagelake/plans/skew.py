"""Joins and top-k that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot from this many rows on, and a slot of it holds about as many.
HOT_ROWS = 1_000_000
# Keys past the heaviest 1000 own less than a thousandth of the rows each.
MOST_HOT_KEYS = 1000
TOP_SLOTS = 64
BROADCAST_BYTES = 64 * 1024 * 1024
# Spark limits window groups before the shuffle up to this rank (its default threshold).
WINDOW_LIMIT = 1000


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than `rows` rows and over how many slots to spread each; None if none.

    Counted with partial aggregation. Never more than MOST_HOT_KEYS keys, whatever the
    table size: any other key is small against the whole, so it needs no spreading.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows)
    slots = F.ceil(F.col("_rows") / rows).cast("int").alias("_slots")
    heaviest = counts.orderBy(F.col("_rows").desc()).limit(MOST_HOT_KEYS).select(*keys, slots)
    found = heaviest.collect()
    return df.sparkSession.createDataFrame(found, heaviest.schema) if found else None


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """Join a left side that may have hot keys to a right side with few rows per key.

    Rows of a hot key are spread over slots by a hash of `spread_by` (so a retried
    task places them alike); only the right rows of hot keys are repeated, once per
    slot. All other keys stay in slot 0. A hot null key, which meets nothing, is spread as
    well. Without hot keys it is a plain join.
    """
    hot = hot_keys(left, keys, rows)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot.withColumnsRenamed({key: f"_hot_{key}" for key in keys}))
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys])
    gone = ["_slots", *(f"_hot_{key}" for key in keys)]
    slot = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_slots")).cast("int"), F.lit(0))
    slots = F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1)
    spread = left.join(hot, same, "left").withColumn("_slot", slot).drop(*gone)
    repeated = right.join(hot, same, "left").withColumn("_slot", F.explode(slots)).drop(*gone)
    return spread.join(repeated, [*keys, "_slot"], how).drop("_slot")


def field_bytes(field: T.StructField) -> Column:
    """About how many bytes a value takes: its text, or its JSON, or eight."""
    value = F.col(field.name)
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(8)
    return F.octet_length(F.to_json(F.struct(value)))


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the whole table, measured, is small enough to send to every executor."""
    size = df.agg(F.sum(reduce(Column.__add__, map(field_bytes, df.schema.fields)))).first()[0]
    return (size or 0) <= max_bytes


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: list[str]) -> DataFrame:
    """Join to a lookup table: broadcast it when its measured size allows, else `skew_join`."""
    if fits(right):
        return left.join(F.broadcast(right), keys, how)
    return skew_join(left, right, keys, how, spread_by)


def keep_listed(df: DataFrame, listed: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join of a wide table with unique keys. A list of bounded size is
    broadcast, so the wide rows stay where they are."""
    return df.join(F.broadcast(listed) if fits(listed) else listed, keys, how)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k, spread_by: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows per key, ranked from 1. k is a number or a column fixed per key.

    Small fixed k: Spark keeps k rows per key and map task before it shuffles. Otherwise
    each key is first cut to k rows in every slot, so no task sorts a whole hot key.
    """
    if not (isinstance(k, int) and k <= WINDOW_LIMIT):
        slot = F.pmod(F.xxhash64(*spread_by), F.lit(TOP_SLOTS))
        local = Window.partitionBy(*keys, "_slot").orderBy(*order)
        df = (
            df.withColumn("_slot", slot)
            .withColumn(rank, F.row_number().over(local))
            .where(F.col(rank) <= k)
            .drop("_slot", rank)
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
