"""As-of join by time slices: no pairs, and no task holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    asked: DataFrame,
    entries: DataFrame,
    keys: list[str],
    asked_at: str,
    entry_at: str,
    slice_width: int,
    found: str = "found",
) -> DataFrame:
    """Each asked row with the latest entry of its key at or before it, as struct `found`.

    Times are whole numbers (microseconds). Both sides are cut into time slices and
    sorted only inside (key, slice). What a slice needs from earlier ones is the last
    entry before it; that is worked out from one row per key and slice, and enters the
    slice as its first entry. Of entries at the same time the greatest wins.
    """
    entry = F.struct(entry_at, *[c for c in entries.columns if c not in (*keys, entry_at)])
    entry_type = entries.select(entry.alias("e")).schema["e"].dataType
    row_type = asked.select(F.struct("*").alias("r")).schema["r"].dataType

    def in_slice(df, at):
        # A slice is named by its first moment.
        return df.withColumn("__at", F.col(at)).withColumn("__slice", F.col(at) - F.pmod(F.col(at), F.lit(slice_width)))

    rows = in_slice(asked, asked_at).select(
        *keys, "__slice", "__at", F.lit(2).alias("__side"), F.lit(None).cast(entry_type).alias(found), F.struct(*asked.columns).alias("__row")
    )
    own = in_slice(entries, entry_at).select(
        *keys, "__slice", "__at", F.lit(1).alias("__side"), entry.alias(found), F.lit(None).cast(row_type).alias("__row")
    )
    # One row per key and slice, from either side, with the slice's last entry if it has one.
    both = own.select(*keys, "__slice", found).unionByName(rows.select(*keys, "__slice", found))
    per_slice = both.groupBy(*keys, "__slice").agg(F.max(found).alias(found))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumn(found, F.last(found, ignorenulls=True).over(earlier)).where(F.col(found).isNotNull())
    carried = carried.select(
        *keys, "__slice", F.col("__slice").alias("__at"), F.lit(0).alias("__side"), found, F.lit(None).cast(row_type).alias("__row")
    )
    so_far = (
        Window.partitionBy(*keys, "__slice").orderBy("__at", "__side", found).rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = rows.unionByName(own).unionByName(carried)
    filled = placed.withColumn(found, F.last(found, ignorenulls=True).over(so_far))
    return filled.where(F.col("__side") == 2).select("__row.*", found)
