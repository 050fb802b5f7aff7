"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `virtual` points on a ring of 64-bit hashes; a key belongs to the next
point clockwise. A shard takes rows up to its capacity; rows that find it full go on
clockwise to the next shard on the ring that is not. Capacities that add up to the row
count (slack 0) make the counts differ by one at most; slack trades balance for movement.

All keys of one arc (between two points) see the shards in the same order, so the
filling needs only the rows per arc: at most shards * virtual numbers, whatever the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import gapless_rank, numbered

VIRTUAL = 128


def ring_points(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions on the ring and the shard of each. A shard's points depend on it alone."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True), s)
        for s in range(shards)
        for v in range(virtual)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Rows that each shard may take. Slack 0: they add up to the row count exactly."""
    even = np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)
    return even if not slack else np.maximum(even, int(np.ceil((1 + slack) * rows / shards)))


def fill_clockwise(owners: np.ndarray, counts: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, first rank, rows, shard) that place every row of every arc.

    Hop by hop: all rows first ask the shard they belong to, then the overflow asks the
    next other shard clockwise. Each row asks every shard once at most.
    """
    arcs, shards = len(owners), len(capacity)
    tour = np.empty((arcs, shards), np.int64)
    ahead: list[int] = list(dict.fromkeys(owners.tolist()))
    for arc in range(arcs - 1, -1, -1):  # the order of first meetings from each arc on
        ahead.remove(int(owners[arc]))
        ahead.insert(0, int(owners[arc]))
        tour[arc] = ahead
    left, room, done, pieces = counts.astype(np.int64).copy(), capacity.astype(np.int64).copy(), np.zeros(arcs, np.int64), []
    for hop in range(shards):
        for arc in np.flatnonzero(left):
            shard = tour[arc, hop]
            take = min(left[arc], room[shard])
            if take:
                pieces.append((int(arc), int(done[arc]), int(take), int(shard)))
                left[arc] -= take
                done[arc] += take
                room[shard] -= take
    return sorted(pieces)


def ring_shards(rows: DataFrame, key: str, shards: int, virtual: int = VIRTUAL, slack: float = 0.0, row: str = "row") -> DataFrame:
    """The rows with `shard` (int) and `slot` (long, from 0 without gaps in each shard).

    `rows` is a written table with a unique number in `row`. Null keys hash like any value;
    repeated keys share an arc and are split over tasks by row number. An empty table gives none.
    """
    points, owners = ring_points(shards, virtual)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, position.to_numpy(np.int64)) % len(points))

    ranked, sizes = gapless_rank(rows.withColumn("_arc", arc_of(F.xxhash64(key))), "_arc", row, "_rank")
    counts = np.array([sizes.get(a, 0) for a in range(len(points))], np.int64)
    pieces = fill_clockwise(owners, counts, capacities(int(counts.sum()), shards, slack))
    starts = np.concatenate([[0], np.cumsum(counts)])
    filled = np.zeros(shards, np.int64)
    begin, shard_of, slot_of = [], [], []
    for arc, first, taken, shard in pieces:
        begin.append(starts[arc] + first)
        shard_of.append(shard)
        slot_of.append(filled[shard])
        filled[shard] += taken
    begin, shard_of, slot_of = (np.array(x, np.int64) for x in (begin, shard_of, slot_of))

    @F.pandas_udf("struct<shard int, slot long>")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = starts[arc.to_numpy(np.int64)] + rank.to_numpy(np.int64)
        piece = np.searchsorted(begin, at, side="right") - 1
        return pd.DataFrame({"shard": shard_of[piece], "slot": slot_of[piece] + at - begin[piece]})

    return ranked.withColumn("_place", place("_arc", "_rank")).select(*rows.columns, "_place.shard", "_place.slot")


def shard_documents(docs: DataFrame, shards: int, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot.

    Null text has no bytes, null doc_id is a key like others, repeated rows each get a slot.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return ring_shards(numbered(narrow, "shard-rows"), "doc_id", shards, virtual, slack).drop("row")
