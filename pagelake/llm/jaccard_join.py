"""Documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8: a size-aware join.

Two sets of sizes a and b link when they share t(a, b) shingles, the least whole number of at least
4 (a + b) / 9. Light sets (few shingles) are joined by enumerating their subsets of t(a, b) shingles for each
pair of sizes: an equal subset is the link. Heavy sets scan inverted lists. The sizes up
to which sets are light are chosen by cost: subsets to enumerate against list entries to scan, both counted.

A set's shingles are ordered from rare to frequent (by a count sketch over all documents; any
order gives the same links). Sets that link share one of their first n - ceil(0.8 n) + 1 shingles, so
only these enter the lists, and at the first one they share, at places i and j, the rests n_a - i and n_b - j
must still hold t(a, b) shingles. So unlike texts around one frequent passage don't meet.

Pairs that meet are first compared by the least shingles of 64 ranges of hashes, which passes all that link, then
exactly. Within a component not every pair is measured: each list's most central member (fewest rarer
shingles) meets all others, then a few more do; lists whose members are in one component are settled, and in
the others members of different components meet, each pair once. What an entry needs to know of its list comes
to it where the list is made or by a window, so the entries move once for it and not once for a sum and again for a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.components import components, merged
from pagelake.llm.shared import keep_rows, numbered
from pagelake.plans.reuse import materialize, scratch_scope
from pagelake.plans.skew import hot_keys, lookup_join, skew_join

SHINGLE = 5
# Light sets are looked for up to this size; larger ones have too many subsets.
MOST_LIGHT = 24
# A pair that is met on a list costs as much as so many subsets.
PAIR_COST = 20
# Counters of the sketch, and in how many places a shingle is counted.
COUNTERS, PLACES = 1 << 15, 3
# The range of hashes is cut into bins; two sets that link have another least shingle in a bin with probability 0.2
# at most, so in more than MOST_APART of them less than once in 10^13 pairs.
BINS, MOST_APART = 64, 40
WORDS_KEPT = 100_000
# Rows with whole sets of one key in a task.
WIDE_ROWS = 20_000
# Further central members of each open list that meet all its other ones: the most central of each of so many classes.
LEADERS = 4
# Lists of more entries aren't held in one task; they are found from one row in SAMPLED.
LONG_LIST, SAMPLED = 1_000_000, 64
# Entries whose lists are made at once, those that a task deals out at once, and the columns they are packed in.
BUCKET_ENTRIES, DEALT_AT_ONCE = 100_000, 1_000_000
PACKED = ["bucket", "token", "row", "n", "pos"]
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def needed(a: int, b: int) -> int:
    """How many shingles sets of these sizes must share to link: 100 * shared >= 80 * (a + b - shared)."""
    return -(-4 * (a + b) // 9)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * ODD[0]
    values = (values ^ (values >> np.uint64(27))) * ODD[1]
    return values ^ (values >> np.uint64(31))


class Shingler:
    """UTF-8 texts to 64-bit shingle hashes; a worker remembers the hashes of words it has seen."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, raw: bytes) -> np.ndarray:
        """Distinct shingles, sorted. Bytes are lower-cased from A to Z and split at ASCII white space."""
        words, known = raw.lower().split(), self.known
        try:
            hashes = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            hashes = np.array([known[w] for w in words], np.uint64)
        n, size = len(hashes), min(SHINGLE, len(hashes))
        if not n:
            return hashes
        run = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            run = (run ^ hashes[k : n - size + 1 + k]) * ODD[k]
            run ^= run >> np.uint64(29)
        return np.unique(mixed(run))


def raw_texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def slots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each shingle (columns) in each of its places (rows)."""
    at = np.stack([(shingles >> np.uint64(16 * k)) % np.uint64(COUNTERS) + np.uint64(k * COUNTERS) for k in range(PLACES)])
    sign = np.stack([(shingles >> np.uint64(63 - k)) & np.uint64(1) for k in range(PLACES)])
    return at.astype(np.int64), 1 - 2 * sign.astype(np.int64)


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Signed sums over the distinct shingles of all documents (a count sketch). A shingle's sum times its
    sign estimates in how many documents it stands. Each task sends its counters once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sums = Shingler(), np.zeros(PLACES * COUNTERS, np.int64)
        for batch in batches:
            for raw in raw_texts(batch, 0):
                np.add.at(sums, *slots(shingler.shingles(raw)))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["slot", "total"])

    parts = docs.select("text").mapInArrow(count, "slot long, total long")
    out = np.zeros(PLACES * COUNTERS, np.int64)
    for slot, total in parts.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[slot] = total
    return out


def least_by_bin(shingles: np.ndarray) -> bytes:
    """A byte of the least shingle of each bin, 0 for an empty bin. `shingles` is sorted."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(shingles, edges)
    ends = np.append(at[1:], len(shingles))
    first = shingles[np.minimum(at, len(shingles) - 1)] if len(shingles) else np.zeros(BINS, np.uint64)
    return np.where(at < ends, 1 + mixed(first) % np.uint64(255), np.uint64(0)).astype(np.uint8).tobytes()


def estimates(sketch: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The largest of a shingle's estimates: a frequent shingle looks rare only if others hide it in all its places."""
    at, sign = slots(shingles)
    return np.maximum((sketch[at] * sign).max(0), 0)


def led_sets(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(row, doc_id, digest, bins, n, lead): a set's digest, `least_by_bin`, its size, and its rarest shingles in order (all of a set of
    up to MOST_LIGHT, else those that enter lists). Written once."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            digests, bins, sizes, leads = [], [], [], []
            for raw in raw_texts(batch, 1):
                shingles = shingler.shingles(raw)
                n = len(shingles)
                order = np.argsort(estimates(sketch, shingles), kind="stable")
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bins.append(least_by_bin(shingles))
                sizes.append(n)
                leads.append(shingles[order[: n if n <= MOST_LIGHT else entering(n)]].view(np.int64))
            columns = [pa.array(digests, pa.binary()), pa.array(bins, pa.binary()), pa.array(sizes, pa.int64()), pa.array(leads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "digest", "bins", "n", "lead"])

    return numbered(docs.mapInArrow(lead, "doc_id long, digest binary, bins binary, n long, lead array<long>"), "led-sets")


def entering(n):
    """How many of a set's n shingles enter lists; n is a number or a column."""
    return n - (4 * n + 4) // 5 + 1 if isinstance(n, int) else (n - F.floor((4 * n + 4) / 5) + 1).cast("int")


@cache
def left_out(n: int, t: int) -> np.ndarray:
    """Every choice of n - t of n places."""
    return np.array(list(combinations(range(n), n - t)), np.int64).reshape(comb(n, t), n - t)


def size_pairs(n: int, most: int) -> list[tuple[int, int]]:
    """The pairs of sizes (a, b), a <= b <= most, that may link, one of them n, without those that only equal sets meet."""
    smaller = [(a, n) for a in range(1, n) if 5 * a >= 4 * n]
    larger = [(n, b) for b in range(n, most + 1) if 5 * n >= 4 * b]
    return [(a, b) for a, b in smaller + larger if needed(a, b) < b]


def subsets(n: int, most: int) -> int:
    """How many subsets a set of size n enumerates."""
    return sum(comb(n, needed(a, b)) for a, b in size_pairs(n, most))


def light_links(sets: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that connect the sets of up to `most` shingles: those with an equal subset
    for their pair of sizes, each to the first such set."""

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, roles, rows = [], [], []
            for row, lead in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = mixed(lead.values.to_numpy().view(np.uint64))
                n = len(hashes)
                for a, b in size_pairs(n, most):
                    out = left_out(n, needed(a, b))
                    key = mixed((hashes.sum() - hashes[out].sum(1, dtype=np.uint64)) ^ (np.uint64(a * 64 + b) * MIX)).view(np.int64)
                    keys.append(key)
                    roles.append(np.full(len(key), 0 if a == b else 1 if n == a else 2, np.int8))
                    rows.append(np.full(len(key), row, np.int64))
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([join(keys, np.int64), join(roles, np.int8), join(rows, np.int64)], names=["key", "role", "row"])

    made = sets.where(F.col("n") <= most).select("row", "lead").mapInArrow(enumerate_subsets, "key long, role byte, row long")
    made = materialize(made, "light-subsets")
    first = made.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("last"), F.min("role").alias("low"), F.max("role").alias("high"))
    # Of two different sizes both must be there.
    first = first.where("a < last AND (low = 0 OR low < high)").select("key", "a")
    return skew_join(made.select("key", F.col("row").alias("b")), first, ["key"], "inner", ["b"]).where("a < b").select("a", "b").distinct()


def light_bound(sets: DataFrame, spots: DataFrame) -> int:
    """Up to which size sets are light: the bound with the least cost in subsets and met pairs, from counts by size."""
    numbers = {r[0]: r[1] for r in sets.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    small = spots.where(F.col("n") <= MOST_LIGHT)
    others = small.groupBy("token").agg((F.count(F.lit(1)) - 1).alias("others"))
    met = {r[0]: r[1] / 2 for r in small.select("token", "n").join(others, "token").groupBy("n").agg(F.sum("others")).collect()}
    scan = lambda n: met.get(n, 0) * PAIR_COST + numbers.get(n, 0) * entering(n)
    cost = lambda most: sum(numbers.get(n, 0) * subsets(n, most) if n <= most else scan(n) for n in range(1, MOST_LIGHT + 1))
    return min(range(MOST_LIGHT + 1), key=lambda most: (cost(most), most))


def long_lists(entries: DataFrame) -> DataFrame | None:
    """The tokens of about LONG_LIST entries or more, MOST_HOT_KEYS at most; None if there are none."""
    sampled = entries.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("token")
    found = hot_keys(sampled, ["token"], LONG_LIST // SAMPLED)
    return found and found.select("token")


def with_sums(entries: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """The entries of a few long lists with these aggregates over their lists, made in parts and looked up."""
    per_list = entries.groupBy("token").agg(*[total.alias(name) for name, total in sums.items()])
    return entries.join(F.broadcast(per_list), "token")


def with_list(entries: DataFrame, **sums: Column) -> DataFrame:
    """The entries with these aggregates over their lists. They are shuffled once, and no task holds a long list."""
    over = lambda short: short.repartition("token").select(
        "*", *[total.over(Window.partitionBy("token")).alias(name) for name, total in sums.items()]
    )
    long = long_lists(entries)
    if long is None:
        return over(entries)
    short = entries.join(F.broadcast(long), "token", "left_anti")
    return over(short).unionByName(with_sums(entries.join(F.broadcast(long), "token", "left_semi"), sums))


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, the lowest byte of all first: the high ones are alike, so they take next to nothing once compressed."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def listed(sets: DataFrame, outlives: bool = False) -> DataFrame:
    """(token, row, n, pos, x): the entries of the inverted lists with at least two; x is the list's most central
    entry. Sets of up to MOST_LIGHT come last for that, as heavy ones may not meet them. Written once.

    Most entries stand alone on their list. They go to buckets of lists as packed numbers, many at once, so an entry
    takes half of what a row of four numbers would. A bucket holds about BUCKET_ENTRIES; long lists are in none."""
    entries = sets.select("row", "n", F.posexplode(F.slice("lead", F.lit(1), entering(F.col("n")))).alias("pos", "token"))
    small = F.col("n") <= MOST_LIGHT
    sums = {"members": F.count(F.lit(1)), "x": F.min(F.struct(small.alias("small"), "pos", "row", "n"))}
    number = sets.agg(F.sum(entering(F.col("n")))).first()[0] or 0
    buckets, long = -(-number // BUCKET_ENTRIES) or 1, long_lists(entries)
    apart = np.array([r[0] for r in long.collect()] if long else [], np.int64)

    def of_batch(batch: pa.RecordBatch) -> list[np.ndarray]:
        row, n, lead = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        lengths = lead.value_lengths().to_numpy()
        pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        token = lead.flatten().to_numpy()
        inside = (pos < np.repeat(n - (4 * n + 4) // 5 + 1, lengths)) & ~np.isin(token, apart)
        return [x[inside] for x in (token, np.repeat(row, lengths), np.repeat(n, lengths), pos)]

    def packed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        numbers = [np.concatenate(x) for x in zip(*parts)]
        bucket = (mixed(numbers[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        named, starts = np.unique(bucket[order], return_index=True)
        tokens, rows, *others = (np.split(x[order], starts[1:]) if len(named) else [] for x in numbers)
        # Rows of a task ascend, so their steps are small.
        others = [[np.diff(x, prepend=0) for x in rows], *others]
        columns = [[x.tobytes() for x in tokens], *([planes(x) for x in part] for part in others)]
        return pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=PACKED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(of_batch(batch))
            held += len(parts[-1][0])
            if held >= DEALT_AT_ONCE:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)

    def gather(packed: pa.Table) -> pa.Table:
        columns = {name: [x.as_py() for x in packed.column(name)] for name in PACKED[1:]}
        token = np.frombuffer(b"".join(columns["token"]), np.int64)
        row = np.concatenate([np.cumsum(from_planes(x)) for x in columns["row"]])
        n, pos = (np.concatenate([from_planes(x) for x in columns[name]]) for name in ("n", "pos"))
        order = np.argsort(token)
        same = token[order][1:] == token[order][:-1]
        shared = order[np.append(same, False) | np.append(False, same)]
        shared = shared[np.lexsort((row[shared], pos[shared], n[shared] <= MOST_LIGHT, token[shared]))]
        token, row, n, pos = token[shared], row[shared], n[shared], pos[shared].astype(np.int32)
        _, first, members = np.unique(token, return_index=True, return_counts=True)
        x = pa.StructArray.from_arrays([np.repeat(c[first], members) for c in (pos, row, n)], names=["pos", "row", "n"])
        return pa.table({"token": token, "row": row, "n": n, "pos": pos, "x": x})

    dealt = sets.select("row", "n", "lead").mapInArrow(deal, "bucket long, token binary, row binary, n binary, pos binary")
    out = dealt.groupBy("bucket").applyInArrow(gather, "token long, row long, n long, pos int, x struct<pos: int, row: long, n: long>")
    if long:
        of_long = with_sums(entries.join(F.broadcast(long), "token", "left_semi"), sums).where("members > 1")
        out = out.unionByName(of_long.select("token", "row", "n", "pos", F.col("x").dropFields("small").alias("x")))
    return materialize(out, "lists", outlives)


def whole_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, shingles) of the rows of these pairs (a, b), made again from their texts. A row that is there twice does no harm. Written once."""
    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    named = materialize(keep_rows(rows.select("row", "doc_id", "digest"), wanted, "left_semi", "row"), "wanted-sets")
    texts = keep_rows(docs, named.select("doc_id").distinct(), "left_semi", "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(raw).tobytes() for raw in raw_texts(batch, 0)]
            columns = [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "shingles"])

    made = texts.select("text").mapInArrow(make, "digest binary, shingles binary")
    return materialize(lookup_join(made, named.select("row", "digest"), ["digest"], "inner", ["shingles"]).select("row", "shingles"), "whole-sets")


def linked(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Written once; the whole sets are removed after that."""

    @F.pandas_udf("boolean")
    def link(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(one, two):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * shared >= 80 * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    @F.pandas_udf("boolean")
    def close(one: pd.Series, two: pd.Series) -> pd.Series:
        load = lambda raw: np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BINS)
        return pd.Series((load(one) != load(two)).sum(1) <= MOST_APART)

    with scratch_scope(rows.sparkSession):
        pairs = _with_both(pairs, rows, "bins").where(close("bins_a", "bins_b")).select("a", "b")
        pairs = materialize(pairs, "close-pairs")
        met = _with_both(pairs, whole_sets(docs, rows, pairs), "shingles")
        return materialize(met.where(link("shingles_a", "shingles_b")).select("a", "b").distinct(), "links", outlives=True)


def _with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with a column of both rows."""
    side = lambda end: rows.select(F.col("row").alias(end), F.col(column).alias(f"{column}_{end}"))
    met = skew_join(pairs, side("b"), ["b"], "inner", ["a"], WIDE_ROWS)
    return skew_join(met, side("a"), ["a"], "inner", ["b"], WIDE_ROWS)


def may_link(a: str, b: str, most: int) -> Column:
    """Whether the entries (structs of row, n, pos) of two sets on one list leave a link open. Two light sets are settled."""
    n_a, n_b, rest_a, rest_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")
    near = 5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)
    return near & (9 * F.least(rest_a, rest_b) >= 4 * (n_a + n_b)) & (F.greatest(n_a, n_b) > most)


def in_order(met: DataFrame, a: str = "x.row", b: str = "y.row") -> DataFrame:
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def heavy_links(spots: DataFrame, roots: DataFrame, most: int, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The components `roots` after the links between sets of which one is larger than `most`."""
    entry = F.struct("pos", "row", "n")
    stars = spots.select("x", entry.alias("y")).where("x.row <> y.row").where(may_link("x", "y", most))
    known = materialize(in_order(stars), "met-pairs")
    roots = merged(roots, linked(known, docs, rows))

    def still_open(**told: Column) -> DataFrame:
        """The entries (token, entry, own) of lists with several components, with the component of each and these aggregates over its list."""
        owners = roots.select(F.col("node").alias("row"), "root")
        own = lookup_join(spots.select("token", "row", "n", "pos"), owners, ["row"], "left", ["token"])
        own = own.select("token", "row", "n", "pos", F.coalesce("root", "row").alias("own"))
        several = with_list(own, one=F.min("own"), two=F.max("own"), **told).where("one <> two")
        return several.select("token", entry.alias("entry"), "own", *told)

    def new(met: DataFrame) -> DataFrame:
        met = met.where("own_x <> own_y").where(may_link("x", "y", most))
        return materialize(in_order(met).join(known, ["a", "b"], "left_anti"), "met-pairs")

    of_class = lambda k: F.pmod(F.xxhash64("row"), F.lit(LEADERS)) == k
    leaders = {f"x{k}": F.min(F.when(of_class(k), F.struct("pos", "row", "n", "own"))) for k in range(LEADERS)}
    ahead = still_open(**leaders).select(F.explode(F.array_compact(F.array(*leaders))).alias("x"), F.col("entry").alias("y"), F.col("own").alias("own_y"))
    more = new(ahead.withColumn("own_x", F.col("x.own")))
    known = known.unionByName(more)
    roots = merged(roots, linked(more, docs, rows))
    entries = materialize(still_open(), "open-lists")
    x, y = (entries.select("token", F.col("entry").alias(end), F.col("own").alias(f"own_{end}")) for end in "xy")
    return merged(roots, linked(new(x.join(y, "token").where("x.row < y.row")), docs, rows))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A text of fewer words than a shingle has is one shingle. Null, empty and wordless texts have none
    and their own id as component. Every row of a repeated id is a document; null ids count only
    where a component has no other. An empty table gives no rows. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch_scope(docs.sparkSession):
        led = led_sets(docs, frequency_sketch(docs))
        same = led.where("n > 0").groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
        same = materialize(same, "same-sets", outlives=True)
        sets = led.select("row", "n", "lead").join(same.select("row"), "row", "left_semi")
        spots = listed(sets, outlives=True)
        most = light_bound(sets, spots)
        light = materialize(sets.where(F.col("n") <= most), "light-sets", outlives=True)
        rows = materialize(led.drop("lead"), "rows", outlives=True)
    roots = components(light_links(light, most))
    # Sets too small for any heavy one are done.
    spots = spots.where(5 * F.col("n") >= 4 * F.lit(most + 1))
    roots = heavy_links(spots, roots, most, docs, rows)
    owned = same.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    owned = materialize(owned, "owned-sets")
    whole = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = skew_join(owned.select("digest", "root", "row"), whole, ["root"], "inner", ["row"]).select("digest", "component_id")
    told = skew_join(rows.where("n > 0").select("doc_id", "n", "digest", "row"), materialize(classes, "set-classes"), ["digest"], "inner", ["row"])
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return told.select("doc_id", "n", "component_id").unionByName(none).withColumnRenamed("n", "n_shingles")
