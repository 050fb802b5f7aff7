"""Near duplicates by improved consistent weighted sampling (Ioffe 2010).

A document is the weighted set of its five-word shingles. A shingle's weight is
(1 + log tf) * (1 + idf), idf scaled to 0..1; document frequencies of all documents are counted in
DF_BUCKETS hashed counters, so a shingle counts as no rarer than its counter's share
of other shingles. A sample picks one (shingle, level); two
documents pick the same with probability equal to their weighted Jaccard similarity.
BANDS bands of ROWS samples find candidates. All samples of a candidate pair estimate its
similarity; unless that is DOUBT standard deviations too low, the exact weighted similarity decides.

Texts with equal words are one representative from the start. In a bucket every member is
first compared with the bucket's smallest one, which settles large groups of near copies
with one comparison each. A member leaves when it is in the smallest one's class
and, by the triangle inequality of the distance, can't be close to any member that is not.
LEADERS more of each bucket meet the open members, classes are merged, and open members of small
buckets are compared pair by pair; those of crowded buckets (a frequent
passage brings unlike texts together) meet by their rare shingles, as far as the weights they
can share reach the similarity (`crowd_pairs`, exact). So a group of near copies costs one comparison a member, and a
frequent passage no more than its few alike texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.components import components, merged
from pagelake.llm.shared import keep_judged, keep_rows, numbered
from pagelake.plans.reuse import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
# A pair whose samples agree by this many standard deviations less than asked is not measured.
DOUBT = 5.0
DF_BUCKETS = 1 << 16
POOL = 1 << 16
SEED = 20100713
# Open rows of buckets with more of them meet by their rare shingles, which loses no pair.
CROWDED = 8
# Sums of weights are compared with so much room.
ROUNDING = 1 - 1e-6
# So many further rows of each bucket meet all its open ones before that.
LEADERS = 4
WORDS_KEPT = 100_000
# So many digests a task remembers at once.
DIGESTS_KEPT = 200_000
HASHES_AT_ONCE = 24
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Shingler:
    """Texts to hashed shingles; a worker remembers the hashes of words it has seen."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def word_hashes(self, text: str | None) -> np.ndarray:
        found, known = WORD.findall((text or "").lower()), self.known
        try:
            return np.array([known[w] for w in found], np.uint64)
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in set(found).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            return np.array([known[w] for w in found], np.uint64)

    def stream(self, hashes: np.ndarray) -> np.ndarray:
        """The 32-bit hash of every run of five words. A text of fewer words is one run."""
        n = len(hashes)
        size = min(SHINGLE, n)
        if not n:
            return np.empty(0, np.uint32)
        mixed = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            mixed += (hashes[k : n - size + 1 + k] ^ (hashes[k : n - size + 1 + k] >> np.uint64(31))) * ODD[k]
            mixed ^= mixed >> np.uint64(27)
        mixed *= MIX
        return (mixed >> np.uint64(32)).astype(np.uint32)

    def shingles(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, sorted, and their counts."""
        return np.unique(self.stream(hashes), return_counts=True)


class Sampler:
    """Weights and consistent weighted samples; its tables come from a fixed seed."""

    def __init__(self, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS):
        self.idf, self.bands, self.rows = idf.astype(np.float32), bands, rows
        self.tables: tuple[np.ndarray, ...] | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def weights(self, shingles: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        scale = 1 + self.idf[shingles & np.uint32(DF_BUCKETS - 1)]
        return scale if counts is None else scale * (1 + np.log(counts)).astype(np.float32)

    def samples(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit name of a (shingle, level) per sample."""
        if self.tables is None:
            draw = np.random.default_rng(SEED)
            gamma = lambda: -np.log1p(-draw.random(POOL)) - np.log1p(-draw.random(POOL))
            odd = draw.integers(1 << 62, size=self.bands * self.rows, dtype=np.uint64) | np.uint64(1)
            self.tables = gamma().astype(np.float32), np.log(gamma()).astype(np.float32), draw.random(POOL, np.float32), odd
        r_table, c_table, beta_table, odd = self.tables
        spread = shingles.astype(np.uint64) * MIX
        spread ^= spread >> np.uint64(32)
        log_w, picked = np.log(weights), np.empty(len(odd), np.uint64)
        for begin in range(0, len(odd), HASHES_AT_ONCE):
            some = odd[begin : begin + HASHES_AT_ONCE]
            at = spread * some[:, None]
            at >>= np.uint64(48)
            at = at.view(np.intp)
            r, score = r_table.take(at), beta_table.take(at)
            level = log_w / r
            level += score
            np.floor(level, out=level)
            score -= level
            score -= 1
            score *= r
            score += c_table.take(at)
            best = score.argmin(1)
            chosen = level[np.arange(len(some)), best].astype(np.int64).view(np.uint64)
            picked[begin : begin + HASHES_AT_ONCE] = (shingles[best].astype(np.uint64) * ODD[0] + chosen) * MIX
        return picked ^ (picked >> np.uint64(32))

    def band_keys(self, picked: np.ndarray) -> np.ndarray:
        """One key per band of `rows` samples."""
        picked = picked.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1).astype(np.uint64) * ODD[1]
        for k in range(self.rows):
            key = (key ^ picked[:, k]) * ODD[2 + k % 3]
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def doubt(self, least: float) -> float:
        """How far an estimate may lie below the asked similarity by chance."""
        return DOUBT * float(np.sqrt(least * (1 - least) / (self.bands * self.rows)))


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets."""
    _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low, high = np.minimum(wa[at], wb[bt]).sum(dtype=float), np.maximum(wa[at], wb[bt]).sum(dtype=float)
    total = wa.sum(dtype=float) + wb.sum(dtype=float) - low - high + high
    return low / total if total else 1.0


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the words, shingles and counts (null if all are one), row. Texts are read here only; written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            digests, sets, times = [], [], []
            for text in batch.column(1):
                hashes = shingler.word_hashes(text.as_py())
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                shingles, counts = shingler.shingles(hashes)
                sets.append(shingles.astype("<u4").tobytes())
                times.append(counts.astype("<u4").tobytes() if len(counts) and counts.max() > 1 else None)
            columns = [batch.column(0), *(pa.array(x, pa.binary()) for x in (digests, sets, times))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "shingles", "times"])

    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return numbered(pairs.mapInArrow(cut, "doc_id long, digest binary, shingles binary, times binary"), "near-sets")


def document_frequencies(sets: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each of DF_BUCKETS counters; the last entry is the number of documents.

    Each task sends its counters once; they are added by bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(DF_BUCKETS + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                # The low 16 bits name the counter; an assignment counts a document once, however many of its shingles meet there.
                held = np.frombuffer(raw.as_buffer(), "<u2")[::2]
                counters[held] = counters[held] + 1
                counters[DF_BUCKETS] += 1
        used = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counters[used], pa.int64())], names=["bucket", "documents"])

    parts = sets.select("shingles").mapInArrow(count, "bucket int, documents long")
    rows = parts.groupBy("bucket").agg(F.sum("documents").alias("documents")).collect()
    out = np.zeros(DF_BUCKETS + 1, np.int64)
    for bucket, documents in rows:
        out[bucket] = documents
    return out


def sampler_for(frequencies: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> Sampler:
    total = max(2, int(frequencies[-1]))
    return Sampler(np.log(total / np.maximum(1, frequencies[:-1])) / np.log(total), bands, rows)


def signatures(sets: DataFrame, sampler: Sampler) -> DataFrame:
    """row, digest, band keys and sketch (16 bits of each sample) of rows of `shingle_sets`, at least one row of each digest. Written once.

    A task samples a digest once as long as it remembers it, so large groups of copies cost little and nothing is shuffled for it.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled: set[bytes] = set()
        for batch in batches:
            bands, sketches, at = [], [], []
            for k, (digest, raw, times) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3))):
                if digest in sampled:
                    continue
                if len(sampled) >= DIGESTS_KEPT:
                    sampled.clear()
                sampled.add(digest)
                at.append(k)
                shingles = np.frombuffer(raw.as_buffer(), "<u4")
                counts = np.frombuffer(times.as_buffer(), "<u4") if times.is_valid else None
                picked = sampler.samples(shingles, sampler.weights(shingles, counts)) if len(shingles) else None
                bands.append([] if picked is None else sampler.band_keys(picked))
                sketches.append(b"" if picked is None else picked.astype("<u2").tobytes())
            mine = pa.array(at, pa.int64())
            columns = [batch.column(0).take(mine), batch.column(1).take(mine), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "digest", "bands", "sketch"])

    made = sets.select("row", "digest", "shingles", "times").mapInArrow(sketch, "row long, digest binary, bands array<long>, sketch binary")
    return materialize(made, "near-signatures")


def _of_pairs(rows: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b) with the given columns of both rows. Only rows of some pair are shuffled."""
    needed = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    used = keep_rows(rows.select("row", *columns), needed, "left_semi", "row")
    side = lambda end: used.select(F.col("row").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


def measured(pairs: DataFrame, signed: DataFrame, sets: DataFrame, sampler: Sampler, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of rows of `signed` with `similarity`: exact where the estimate leaves doubt, else an upper bound below `least`."""
    margin = sampler.doubt(least)

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        load = lambda raw: np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)
        return pd.Series((load(a) == load(b)).mean(1))

    @F.pandas_udf("double")
    def measure(sa: pd.Series, ta: pd.Series, sb: pd.Series, tb: pd.Series) -> pd.Series:
        def load(raw: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray]:
            shingles = np.frombuffer(raw, "<u4")
            return shingles, sampler.weights(shingles, None if times is None else np.frombuffer(times, "<u4"))

        return pd.Series([similarity(*load(a, x), *load(b, y)) for a, x, b, y in zip(sa, ta, sb, tb)])

    guessed = _of_pairs(signed, pairs, ["sketch"]).select("a", "b", estimate("sketch_a", "sketch_b").alias("guess"))
    guessed = materialize(guessed, "near-guessed")
    likely = _of_pairs(sets, guessed.where(F.col("guess") >= least - margin).select("a", "b"), ["shingles", "times"])
    exact = likely.select("a", "b", measure("shingles_a", "times_a", "shingles_b", "times_b").alias("similarity"))
    rest = guessed.where(F.col("guess") < least - margin).select("a", "b", (F.col("guess") + margin).alias("similarity"))
    return materialize(exact.unionByName(rest), "near-pairs")


def near_links(reps: DataFrame, signed: DataFrame, sets: DataFrame, sampler: Sampler, least: float = SIMILARITY) -> DataFrame:
    """Components (node, root) of the representatives under similarity of at least `least`.

    `reps` has row and bands; `signed` is the written table of `signatures`, `sets` that of `shingle_sets`.
    """
    spots = reps.select("row", F.explode("bands").alias("bucket"))
    leaders = spots.groupBy("bucket").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(spots.join(leaders, "bucket"), "near-buckets")
    far = 1 - least
    first = members.where("row <> leader").select(F.col("leader").alias("a"), F.col("row").alias("b")).distinct()
    stars_measured = measured(materialize(first, "near-stars"), signed, sets, sampler, least)
    roots = components(stars_measured.where(F.col("similarity") >= least))

    def classed(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    stars = members.where("row <> leader").join(stars_measured.select(F.col("a").alias("leader"), F.col("b").alias("row"), "similarity"), ["leader", "row"])
    stars = classed(classed(stars, "row", "own"), "leader", "theirs").withColumn("apart", 1 - F.col("similarity"))
    stars = materialize(stars, "near-measured")
    outside = stars.where("own <> theirs").groupBy("bucket").agg(F.min("apart").alias("nearest"))
    stay = stars.join(outside, "bucket").where((F.col("own") != F.col("theirs")) | (F.col("apart") >= F.col("nearest") - far))
    active = materialize(stay.select("bucket", "row", "own"), "near-open")
    known = stars_measured.select("a", "b")

    def mixed(df: DataFrame) -> DataFrame:
        """The open rows of buckets that hold several classes, with the bucket's size."""
        sizes = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("x"), F.max("own").alias("y"))
        return materialize(df.join(sizes.where("x <> y").select("bucket", "n"), "bucket"), "near-open")

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        """The pairs of different classes in a bucket that were not measured yet."""
        sides = [df.select("bucket", F.col("row").alias(end), F.col("own").alias(f"own_{end}")) for df, end in ((one, "a"), (two, "b"))]
        pairs = sides[0].join(sides[1], "bucket").where("a < b AND own_a <> own_b").select("a", "b").distinct()
        return materialize(pairs.join(known, ["a", "b"], "left_anti"), "near-pairs")

    # A few more leaders merge most of what belongs together.
    active = mixed(active)
    ranked = active.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("row")))
    ahead = materialize(ranked.where(F.col("rank") <= LEADERS), "near-leaders")
    more = measured(met(ahead, active), signed, sets, sampler, least)
    known = known.unionByName(more.select("a", "b"))
    roots = merged(roots, more.where(F.col("similarity") >= least))
    rest = active.join(ahead.select("bucket", "row"), ["bucket", "row"], "left_anti").select("bucket", "row")
    active = mixed(classed(rest, "row", "own"))
    small = active.where(F.col("n") <= CROWDED).select("bucket", "row", "own")
    crowd = materialize(active.where(F.col("n") > CROWDED).select("row", "own").distinct(), "near-crowd")
    pairs = met(small, small).unionByName(crowd_pairs(sets, crowd, sampler, least).join(known, ["a", "b"], "left_anti")).distinct()
    last = measured(materialize(pairs, "near-pairs"), signed, sets, sampler, least)
    return merged(roots, last.where(F.col("similarity") >= least))


def crowd_pairs(sets: DataFrame, crowd: DataFrame, sampler: Sampler, least: float) -> DataFrame:
    """All pairs (a, b) of these rows (row, own), of different `own`, that can be similar: no similar pair is left out.

    A row's shingles are ordered from rare to frequent. Similar rows share a shingle before which less than
    1 - least of the weight lies, and at the first one they share the weights from there on must
    still reach what the similarity asks of both sums. So rows that share a frequent passage and little else don't meet.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                shingles = np.frombuffer(batch.column(2)[k].as_buffer(), "<u4")
                times = batch.column(3)[k].as_buffer() if batch.column(3)[k].is_valid else None
                weights = sampler.weights(shingles, None if times is None else np.frombuffer(times, "<u4")).astype(float)
                order = np.argsort(-sampler.idf[shingles & np.uint32(DF_BUCKETS - 1)], kind="stable")
                rest = np.cumsum(weights[order][::-1])[::-1]
                inside = np.flatnonzero(rest >= least * rest[:1] * ROUNDING)
                kept.append((np.full(len(inside), k), shingles[order[inside]].astype(np.int64), np.full(len(inside), rest[:1].sum()), rest[inside]))
            at, token, weight, rest = map(np.concatenate, zip(*kept)) if kept else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *map(pa.array, (token, weight, rest))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "own", "token", "weight", "rest"])

    used = keep_rows(sets.select("row", "shingles", "times"), crowd.select("row"), "left_semi", "row").join(crowd, "row")
    made = used.select("row", "own", "shingles", "times").mapInArrow(entries, "row long, own long, token long, weight double, rest double")
    made = materialize(made, "near-entries")
    sides = [made.select("token", *[F.col(c).alias(f"{c}_{end}") for c in ("row", "own", "weight", "rest")]) for end in "ab"]
    sizes = F.least("weight_a", "weight_b") >= F.greatest("weight_a", "weight_b") * (least * ROUNDING)
    reach = F.least("rest_a", "rest_b") >= (F.col("weight_a") + F.col("weight_b")) * (least / (1 + least) * ROUNDING)
    pairs = sides[0].join(sides[1], "token").where("row_a < row_b AND own_a <> own_b").where(sizes & reach)
    return pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of the class), class_size, kept, digest.

    Classes are connected by links of weighted similarity of at least `least`. Words are
    compared without case and punctuation. Null, empty and wordless texts form one
    class; texts of fewer than five words are one shingle. One row of each class is kept, the one with
    the least doc_id (null ids last; of repeated rows the first). An empty table gives no rows.
    """
    rows = shingle_sets(docs, id_col, text_col)
    sampler = sampler_for(document_frequencies(rows))
    signed = signatures(rows, sampler)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    same = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.join(signed.groupBy("digest").agg(F.min("row").alias("row")), "digest"), "near-same")
    reps = signed.select("row", "bands").join(same.select("row"), "row", "left_semi")
    roots = near_links(reps, signed, rows, sampler, least)
    owned = same.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    whole = owned.groupBy("root").agg(F.min("best").alias("kept"), F.sum("n").alias("class_size"))
    classes = owned.select("digest", "root").join(whole, "root").select("digest", F.col("kept.doc_id").alias("class_id"), F.col("kept.row").alias("kept_row"), "class_size")
    classes = materialize(classes, "near-classes")
    return rows.select("doc_id", "digest", "row").join(classes, "digest").select(
        "doc_id", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"), F.hex("digest").alias("digest")
    )


def words_digest(text: Column) -> Column:
    """The digest that `near_duplicates` gives a text."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        shingler = Shingler()
        return pd.Series([xxhash.xxh3_128_hexdigest(shingler.word_hashes(t).tobytes()).upper() for t in texts])

    return digest(text.cast("string"))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each class of near duplicates; all columns stay."""
    judged = materialize(near_duplicates(docs, least, id_col, text_col), "near-judged")
    return keep_judged(docs, judged, words_digest(F.col(text_col)), "digest", id_col)
