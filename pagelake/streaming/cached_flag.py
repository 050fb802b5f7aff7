"""Which requests of a stream find a live result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelake.operators.cache import SECOND, micros

OUTPUT = "key STRING, request_id LONG, at LONG, cached BOOLEAN"
# Labelled requests to a frame.
ROWS = 10_000


class ResultLives(StatefulProcessor):
    """The same labels by one processor that also keeps the waiting requests, for `transformWithStateInPandas`; every
    bucket costs it several calls to the state store. Per key: the end of the current life, and requests the
    watermark has not passed, in buckets of time.

    Requests wait until the watermark has passed their bucket, so their order, and with it every
    label, does not depend on how the stream was cut into batches. A micro-batch adds a chunk to each bucket it
    has rows for and a timer reads the buckets that are due, one at a time; no other bucket is read or written.
    """

    def __init__(self, ttl: int, width: int):
        self.ttl = ttl
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "ends LONG")
        self.chunks = handle.getMapState("chunks", "bucket LONG", "chunks INT")
        self.waiting = handle.getMapState("waiting", "bucket LONG, chunk INT", "at ARRAY<LONG>, request_id ARRAY<LONG>")

    def passes(self, bucket: int) -> int:
        """The watermark at which a bucket is whole."""
        return due((bucket + 1) * self.width)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for bucket, part in batch.groupby(batch["at"] // self.width):
                bucket = int(bucket)
                known = self.chunks.getValue((bucket,))[0] if self.chunks.containsKey((bucket,)) else 0
                # A missing id is kept as None.
                ids = [None if pd.isna(i) else int(i) for i in part["request_id"]]
                self.waiting.updateValue((bucket, known), (part["at"].tolist(), ids))
                self.chunks.updateValue((bucket,), (known + 1,))
                if not known:
                    self.handle.registerTimer(self.passes(bucket))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        whole = sorted((bucket, chunks) for (bucket,), (chunks,) in self.chunks.iterator() if self.passes(bucket) <= passed)
        ends = before = self.life.get()[0] if self.life.exists() else None
        for bucket, chunks in whole:
            ready = []
            for chunk in range(chunks):
                at, ids = self.waiting.getValue((bucket, chunk))
                ready.extend(zip(at, ids))
                self.waiting.removeKey((bucket, chunk))
            self.chunks.removeKey((bucket,))
            labelled = []
            for at, request_id in sorted(ready, key=lambda row: (row[0], row[1] is not None, row[1] or 0)):
                cached = ends is not None and at < ends
                if not cached:
                    ends = at + self.ttl
                labelled.append((key[0], request_id, at, cached))
            yield pd.DataFrame(labelled, columns=["key", "request_id", "at", "cached"]).astype({"request_id": "Int64"})
        if ends is not None:
            # Requests of the bucket in which a life ends may still wait for it.
            last = self.passes(ends // self.width)
            if last <= passed:
                self.life.clear()
            elif ends != before:
                self.life.update((ends,))
                self.handle.registerTimer(last)

    def close(self) -> None:
        pass


class BucketLives(StatefulProcessor):
    """Per key: the end of the current life. Rows are the requests of the buckets that a micro-batch found whole, in any order."""

    def __init__(self, ttl: int, width: int):
        self.ttl = ttl
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "ends LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Columns as arrays, 17 bytes a request: a key's requests of one micro-batch lie beside each other.
        parts = [[batch[name].to_numpy() for name in ("at", "known", "request_id")] for batch in rows]
        at, known, ids = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, known, at))
        at, known, ids = at[order], known[order], ids[order]
        cached = np.ones(len(at), bool)
        held = self.life.get() if self.life.exists() else None
        ends = held[0] if held else None
        # From one life to the next: the requests between are cached.
        first = 0 if ends is None else int(np.searchsorted(at, ends))
        while first < len(at):
            cached[first] = False
            ends = int(at[first]) + self.ttl
            first = max(first + 1, int(np.searchsorted(at, ends)))
        # Requests of the bucket in which a life ends may still wait for it.
        last = due((ends // self.width + 1) * self.width)
        if last > timerValues.getCurrentWatermarkInMs():
            if not held or held[0] != ends:
                self.life.update((ends,))
                self.handle.registerTimer(last)
        elif held:
            self.life.clear()
        for start in range(0, len(at), ROWS):
            cut = slice(start, start + ROWS)
            # A missing id is kept as None.
            request_id = pd.arrays.IntegerArray(ids[cut], ~known[cut])
            yield pd.DataFrame({"key": key[0], "request_id": request_id, "at": at[cut], "cached": cached[cut]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.life.get() if self.life.exists() else None
        if held and due((held[0] // self.width + 1) * self.width) <= expiredTimerInfo.getExpiryTimeInMs():
            self.life.clear()
        yield from ()

    def close(self) -> None:
        pass


def due(at: int) -> int:
    """The first whole millisecond at or after a time in microseconds."""
    return -(-at // 1000)


def stream_cached_flag(requests: DataFrame, ttl_seconds: int, delay: str, at: str = "ts", id_column: str = "request_id", bucket_seconds: int = 60) -> DataFrame:
    """Adds `cached` to a stream of (key, ts, id): the labels of `operators.cache.cached_flag`.

    A request without a time has no place in event time: it is left out here and is what
    `without_time` returns, for a stream of its own. Needs the RocksDB state store. Requests wait in a window
    aggregate per key and bucket of time, until the watermark has passed the bucket; then they meet the end of the key's
    current life. Rows of a bucket that the watermark has passed are dropped. State holds the requests of one delay
    and a number per key; a label waits for its bucket's end.
    """
    timed = requests.where(F.col(at).isNotNull()).select(
        "key", F.col(id_column).cast("long").alias("request_id"), F.col(at).cast("timestamp").alias("ts"), micros(F.col(at)).alias("at")
    ).withWatermark("ts", delay)
    asked = F.struct("at", F.col("request_id").isNotNull().alias("known"), F.coalesce("request_id", F.lit(0)).alias("request_id"))
    whole = timed.groupBy("key", F.window("ts", f"{bucket_seconds} seconds")).agg(F.collect_list(asked).alias("asked"))
    rows = whole.select("key", F.window_time("window").alias("passed"), F.inline("asked"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=BucketLives(ttl_seconds * SECOND, bucket_seconds * SECOND), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def without_time(requests: DataFrame, at: str = "ts") -> DataFrame:
    """The requests that `stream_cached_flag` leaves out, for a quarantine."""
    return requests.where(F.col(at).isNull())
