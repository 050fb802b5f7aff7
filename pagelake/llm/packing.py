"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The program covers
the length histogram (at most `capacity` numbers, whatever the table) with as few
configurations as possible. It is solved by multiplicative weights: each length has a
weight that falls as the length gets covered; the next configuration is the best knapsack
under the weights (dynamic programming over the capacity), taken in a fraction of what its
scarcest length allows. Multiplicities are rounded down; the rest, a few pieces per
configuration, goes best fit decreasing, again on the histogram. Spark then deals the pieces
of each length to the plan by rank, so no step sees the documents on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import gapless_rank, numbered
from pagelake.llm.word_ids import WordIds, byte_level_learner, chunks, load_tokenizer

CAPACITY = 1024
END_ID = 2
ROUNDS = 800
STEP = 0.2
ETA = 6.0
# A length that is covered but for this share is left to the rounding.
LEFT_OPEN = 0.02
# Documents whose new words are encoded in one call.
DOCS_AT_ONCE = 200


def texts_encoder(path: str, ranks_path: str | None = None, pattern: str | None = None):
    """Texts to their ids as little-endian unsigned 32-bit numbers; see `word_ids`."""
    words = WordIds(byte_level_learner(load_tokenizer(path), ranks_path, pattern))
    return lambda texts: words.texts([chunks(text) for text in texts])


def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None):
    """The same for one text at a time."""
    encode = texts_encoder(path, ranks_path, pattern)
    return lambda text: encode([text])[0]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ranks: tuple[str, str] | None = None
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and is the end id alone. Longer documents are cut into pieces
    of `capacity` ids; the first is the shorter one. Other columns are not looked at.
    `ranks` is the path of the same vocabulary as byte ranks and its pattern, see `encoder`.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = texts_encoder(tokenizer_path, *(ranks or ())), np.array([end_id], "<u4").tobytes()
        for batch in (whole.slice(at, DOCS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, DOCS_AT_ONCE)):
            ids, numbers, starts, lengths, sums = [], [], [], [], []
            texts = encode([text or "" for text in batch.column(1).to_pylist()])
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                raw = text + end
                total, at, k = len(raw) // 4, 0, 0
                while at < total:
                    take = (total - at) % capacity or capacity
                    ids.append(doc_id)
                    numbers.append(k)
                    starts.append(at)
                    lengths.append(take)
                    sums.append(zlib.crc32(raw[4 * at : 4 * (at + take)]))
                    at, k = at + take, k + 1
            columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length stands in the most valuable configuration (unbounded knapsack).
    values[L] is the value of length L, 0 for lengths not to use; ties go to longer ones."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = best[:room] + values[room:0:-1]  # the longest first
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], choice[room] = worth[at], room - at
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        if choice[room]:
            counts[choice[room]] += 1
            room -= choice[room]
        else:
            room -= 1
    return counts


def fractional_cover(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[bytes, float]:
    """Configurations (as bytes of their counts) and how often each is used, by multiplicative weights."""
    need = histogram.astype(float)
    left, used, share = need.copy(), {}, np.arange(capacity + 1) / capacity
    for _ in range(rounds):
        usable = left > LEFT_OPEN * need
        if not usable.any():
            break
        weight = np.exp(-ETA * (1 - left / np.maximum(need, 1)))
        counts = best_configuration(np.where(usable, share * weight, 0.0), capacity)
        inside = counts > 0
        times = STEP * (left[inside] / counts[inside]).min()
        used[counts.tobytes()] = used.get(counts.tobytes(), 0.0) + times
        left = np.maximum(0, left - counts * times)
    return used


def best_fit(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over a histogram: configurations and how often each is used."""
    open_bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(histogram)[::-1]:
        length, count = int(length), int(histogram[length])
        while count:
            room = next((r for r in range(length, capacity + 1) if open_bins[r]), None)
            if room is None:
                full = min(capacity // length, count)
                bins = count // full
                open_bins[capacity - full * length].append(((length,) * full, bins))
                count -= bins * full
                continue
            held, bins = open_bins[room].pop()
            took = min(bins, count)
            if bins > took:
                open_bins[room].append((held, bins - took))
            open_bins[room - length].append((held + (length,), took))
            count -= took
    merged: dict[tuple[int, ...], int] = {}
    for group in open_bins:
        for held, bins in group:
            merged[held] = merged.get(held, 0) + bins
    return [({x: held.count(x) for x in set(held)}, bins) for held, bins in merged.items()]


def packing_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length to count) with whole multiplicities that use up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    plan = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    solution = fractional_cover(left, capacity)
    for raw, times in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        counts = np.frombuffer(raw, np.int64)
        inside = counts > 0
        whole = int(min(np.floor(times + 1e-9), (left[inside] // counts[inside]).min()))
        if whole:
            plan.append(({int(x): int(counts[x]) for x in np.flatnonzero(inside)}, whole))
            left -= counts * whole
    return plan + best_fit(left, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, row: str = "row") -> DataFrame:
    """The pieces with `sequence_id` and `offset`. `pieces` is a written table with `length`
    (1 to capacity) and a unique number in `row`. An empty table gives none."""
    ranked, sizes = gapless_rank(pieces, "length", row, "_rank")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, count in sizes.items():
        histogram[length] = count
    first = np.concatenate([[0], np.cumsum(histogram)])  # pieces with a smaller length
    shares: list[tuple[int, int, int, int, int]] = []  # length, count, per sequence, first sequence, offset
    sequence = 0
    for counts, times in packing_plan(histogram, capacity):
        offset = 0
        for length, n in sorted(counts.items(), reverse=True):
            shares.append((length, n * times, n, sequence, offset))
            offset += n * length
        sequence += times
    shares.sort(key=lambda s: s[0])
    lengths, taken, per, base, offsets = np.array(shares, np.int64).reshape(-1, 5).T.copy()
    begin = np.concatenate([[0], np.cumsum(taken)])[:-1].astype(np.int64)

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size = length.to_numpy(np.int64)
        at = first[size] + rank.to_numpy(np.int64)
        share = np.searchsorted(begin, at, side="right") - 1
        inside = at - begin[share]
        return pd.DataFrame({"sequence_id": base[share] + inside // per[share], "offset": offsets[share] + inside % per[share] * size})

    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ranks: tuple[str, str] | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is packed, also null and empty texts (one id), repeated rows and null ids.
    """
    return pack(numbered(token_pieces(docs, tokenizer_path, capacity, end_id, ranks), "token-pieces"), capacity).drop("row")
