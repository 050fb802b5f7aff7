"""A result cache with a time limit, kept as a table (key, data, created_at, expires_at)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake import settings
from pagelake.plans.asof import as_of
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import HOT_ROWS, fits, hot_keys, keep_listed, skew_join, top_k

CACHE_SCHEMA = "key STRING, data STRING, created_at TIMESTAMP, expires_at TIMESTAMP"
SECOND = 1_000_000
SLICE_SECONDS = 600


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def load_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The cache table; a cache that cannot be found counts as empty."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def cache_entries(results: DataFrame, created_at: Column, ttl_seconds: int = settings.CACHE_TTL_SECONDS) -> DataFrame:
    """New cache rows from (key, data). Only results with data are stored."""
    return results.where(F.col("data").isNotNull()).select(
        "key",
        "data",
        created_at.cast("timestamp").alias("created_at"),
        F.timestamp_micros(micros(created_at) + ttl_seconds * SECOND).alias("expires_at"),
    )


def look_up(requests: DataFrame, cache: DataFrame, at: str = "ts", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Requests (key, ts, ...) with `hit`, and `data` and `created_at` of the live entry.

    The latest entry of the key up to the request's time counts: it is a hit while it
    lives and has data. A request without a key is always a miss. Of entries of one time the one that expires
    last counts, then one with data. Data join last, for hits alone.
    """
    mark = F.xxhash64("data").alias("_mark")
    named = cache.select("key", micros(F.col("created_at")).alias("_created"), micros(F.col("expires_at")).alias("_expires"), F.col("data").isNotNull().alias("_has"), mark, "data", "created_at")
    asked = requests.withColumn("_asked", micros(F.col(at)))
    # Entries of keys that are asked for; only what tells entries apart goes through the as-of join.
    keys = requests.select("key").distinct()
    entries = keep_listed(named, keys, ["key"]) if fits(keys) else named
    entries = entries.select("key", "_created", "_expires", "_has", "_mark")
    narrow = as_of(asked, entries, ["key"], "_asked", "_created", slice_seconds * SECOND, found="_entry")
    live = F.coalesce((F.col("_asked") < F.col("_entry._expires")) & F.col("_entry._has") & F.col("key").isNotNull(), F.lit(False))
    place = ["_created", "_expires", "_mark"]
    narrow = narrow.select(*requests.columns, live.alias("hit"), *[F.when(live, F.col(f"_entry.{name}")).alias(name) for name in place])
    narrow = materialize(narrow, "looked-up-places")
    data = keep_listed(named.where("_has"), narrow.where("hit").select("key").distinct(), ["key"])
    data = data.select("key", *place, "data", "created_at").dropDuplicates(["key", *place])
    found = skew_join(narrow, data, ["key", *place], "left", [at])
    return found.select(*requests.columns, "hit", "data", "created_at")


def cache_lookup(requests: DataFrame, cache: DataFrame, at: str = "ts", slice_seconds: int = SLICE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of `look_up`, which is worked out once for both."""
    looked = materialize(look_up(requests, cache, at, slice_seconds), "looked-up")
    return looked.where("hit").drop("hit"), looked.where("NOT hit").select(*requests.columns)


def cache_upsert(cache: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The cache after storing new rows: the last write per key, without expired rows."""
    stored = cache.withColumn("_fresh", F.lit(0)).unionByName(new.where(F.col("data").isNotNull()).withColumn("_fresh", F.lit(1)))
    alive = stored.where(F.col("expires_at") > now)
    order = [F.col("created_at").desc(), F.col("_fresh").desc(), F.col("data")]
    return top_k(alive, ["key"], order, 1, ["created_at"], rank="_rank").drop("_fresh", "_rank")


def cached_flag(requests: DataFrame, ttl_seconds: int, at: str = "ts", id_column: str = "request_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds `cached` to a log of (key, ts, id): a request with no live result starts a life
    of `ttl_seconds`, the requests inside it are cached and do not prolong it.

    Keys of ordinary size are scanned in time order, one batch at a time with one value
    per key in memory. Keys above `hot_rows` rows are worked out from all their slices at
    once. Both give the same labels: of the requests at a start exactly one is the miss, the
    one with the least id (a null id first). Null keys are one key.
    """
    # Requests without a time come first, all at one moment.
    rows = requests.withColumn("_at", F.coalesce(micros(F.col(at)), F.lit(-(2**62))))
    hot = hot_keys(requests, ["key"], hot_rows)
    if hot is None:
        return _scan(rows, ttl_seconds, id_column)
    hot = F.broadcast(hot.select(F.col("key").alias("_hot_key")))
    same = F.col("key").eqNullSafe(F.col("_hot_key"))
    ordinary = _scan(rows.join(hot, same, "left_anti"), ttl_seconds, id_column)
    return ordinary.unionByName(_hot_flags(rows.join(hot, same, "left_semi"), ttl_seconds, id_column))


def _scan(rows: DataFrame, ttl_seconds: int, id_column: str) -> DataFrame:
    ttl = ttl_seconds * SECOND
    names = [name for name in rows.columns if name != "_at"]

    def flag_batches(batches):
        key = ends = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            at = batch.column("_at").to_numpy()
            cached = np.ones(len(at), dtype=bool)
            runs = keys.dictionary_encode(null_encoding="encode")
            codes = runs.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(at)]
            for first, last in zip(edges, edges[1:]):
                this = keys[first].as_py()
                if this != key:
                    key, ends = this, None
                row = first if ends is None else first + int(np.searchsorted(at[first:last], ends))
                while row < last:
                    cached[row] = False
                    ends = at[row] + ttl
                    row = first + int(np.searchsorted(at[first:last], ends))
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cached)], [*names, "cached"])

    schema = T.StructType([rows.schema[name] for name in names] + [T.StructField("cached", T.BooleanType())])
    ordered = rows.repartition("key").sortWithinPartitions("key", "_at", id_column)
    return ordered.mapInArrow(flag_batches, schema)


def _hot_flags(rows: DataFrame, ttl_seconds: int, id_column: str) -> DataFrame:
    """Lives start at the first request and, from each start, at the first request one
    life later. Those steps are known for every request time at once (an as-of join
    forward in time); doubling the step reaches all starts in log2(lives) rounds.
    """
    ttl = ttl_seconds * SECOND
    names = [name for name in rows.columns if name != "_at"]
    # Keys as text that is never null, so that joins meet null keys as well; rows with a number each.
    marked = F.concat(F.when(F.col("key").isNull(), "n").otherwise("k"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = materialize(rows.withColumns({"_key": marked, "_row": F.monotonically_increasing_id()}), "requests")
    first = F.min(F.struct(F.col(id_column).isNotNull().alias("known"), F.col(id_column).alias("id"), F.col("_row").alias("row")))
    points = materialize(rows.groupBy("_key", "_at").agg(first.alias("_first")), "request-times")
    # Forward in time is backward in negated time.
    asked = points.select("_key", "_at", (-(F.col("_at") + ttl)).alias("_from"))
    later = points.select("_key", (-F.col("_at")).alias("_minus"), F.col("_at").alias("_next"))
    step = as_of(asked, later, ["_key"], "_from", "_minus", min(ttl, SLICE_SECONDS * SECOND))
    step = materialize(step.select("_key", "_at", F.col("found._next").alias("_next")).where(F.col("_next").isNotNull()), "step")
    starts = materialize(points.groupBy("_key").agg(F.min("_at").alias("_at")), "starts")
    known = starts.count()
    while True:
        reached = starts.join(step, ["_key", "_at"]).select("_key", F.col("_next").alias("_at"))
        starts = materialize(starts.unionByName(reached).distinct(), "starts")
        count = starts.count()
        if count == known:
            break
        known = count
        onward = step.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_after"))
        step = materialize(step.join(onward, ["_key", "_next"]).select("_key", "_at", F.col("_after").alias("_next")), "step")
    misses = points.join(starts, ["_key", "_at"], "left_semi").select(F.col("_first.row").alias("_row"), F.lit(False).alias("_hit"))
    return rows.join(misses, "_row", "left").select(*names, F.coalesce("_hit", F.lit(True)).alias("cached"))
