"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item if some run of its words is within floor(edits * n) word edits of
the item's n words. Item-sized windows are compared by a random walk (Chakraborty,
Goldenberg and Koucky): both strings are read with the same random bits, which decide after each
output symbol whether to advance, so strings a few edits apart give outputs a few positions
apart in Hamming distance. A repetition samples BITS output positions and passes a window whose
samples equal the item's. The number of repetitions is set on the benchmark itself: edited
copies of its items are made until the share that passes reaches the target recall; the walk drifts
the more, the longer an item is, and a length class that MOST_REPETITIONS don't bring to the target does
without it. What the walk leaves open is not dropped: a window that holds all of its item's words
but as many as may be edited passes as well, so no leak is lost to chance.
Windows that pass are verified by an exact alignment of the item inside its surroundings.

Which windows are looked at loses nothing: k edits leave a run of at least
(n - k) / (k + 1) of the item's words whole, so every leak holds a gram of that many
words (three at most are used), and a gram fixes the window's place up to k words.

One pass over the documents, no shuffle. The benchmark travels in blocks of at most
ITEMS_PER_BLOCK items; a larger one takes several passes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import fresh

ITEMS_PER_BLOCK = 20_000
EDITS = 0.2
GRAM = 3
BITS = 5
TARGET_RECALL = 0.995
MOST_REPETITIONS = 64
TRIAL_COPIES = 400
WINDOWS_AT_ONCE = 200_000
WORD = re.compile(r"\w+")
HITS = "array<struct<item_id long, start int, stop int, distance int>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(n: int, edits: float = EDITS) -> int:
    return int(edits * n + 1e-9)


def gram_size(n: int, edits: float = EDITS) -> int:
    """Words of an item that stay whole in a row under the allowed edits; GRAM at most."""
    k = allowed(n, edits)
    return min(GRAM, -(-(n - k) // (k + 1)))


def walk(symbols: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """The walk's output at the given steps (sorted) for each row of `symbols`, which end with a pad symbol 0.

    Bit (step, symbol) is a hash; all rows of one seed share it. The pad stays where it is.
    """
    rows, last = np.arange(len(symbols)), symbols.shape[1] - 1
    at = np.zeros(len(symbols), np.int64)
    out = np.empty((len(symbols), len(steps)), symbols.dtype)
    wanted = {int(s): k for k, s in enumerate(steps)}
    factor = np.uint64(0x9E3779B97F4A7C15)
    for step in range(int(steps[-1]) + 1):
        now = symbols[rows, at]
        if step in wanted:
            out[:, wanted[step]] = now
        mixed = (now.astype(np.uint64) + np.uint64(seed * 1_000_003 + step * 7919 + 1)) * factor
        mixed ^= mixed >> np.uint64(29)
        at = np.minimum(at + ((mixed * factor) >> np.uint64(63)).astype(np.int64), last)
    return out


def fit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits between the item and any run of the region; the run's start and stop."""
    width = len(region) + 1
    columns = np.arange(width)
    cost, start = np.zeros(width, np.int64), columns.copy()
    for symbol in item:
        swap = np.concatenate([[cost[0] + 1], cost[:-1] + (region != symbol)])
        drop = cost + 1
        best = np.minimum(swap, drop)
        begin = np.where(swap <= drop, np.concatenate([[start[0]], start[:-1]]), start)
        lowest = np.minimum.accumulate(best - columns)
        source = np.maximum.accumulate(np.where(best - columns == lowest, columns, 0))  # inserts come from there
        cost, start = lowest + columns, begin[source]
    stop = int(cost.argmin())
    return int(cost[stop]), int(start[stop]), stop


class Detector:
    """A block of benchmark items, ready to travel with tasks."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, target: float = TARGET_RECALL):
        self.edits = edits
        vocabulary: dict[str, int] = {}
        self.items = []  # (item_id, symbols from 2 on; 1 is any other word, 0 the pad)
        for item_id, text in sorted(items):
            found = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words(text)]
            if found:
                self.items.append((item_id, np.array(found, np.int64)))
        self.vocabulary = vocabulary
        self.base = len(vocabulary) + 2
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, symbols) in enumerate(self.items):
            g = gram_size(len(symbols), edits)
            by_size.setdefault(g, []).extend((int(key), k, o) for o, key in enumerate(self.keys(symbols, g)))
        for g, rows in by_size.items():
            self.grams[g] = tuple(np.array(x, np.int64) for x in zip(*sorted(rows)))
        self.classes: dict[int, list[int]] = {}  # items by length class, so that short ones aren't padded far
        for k, (_, symbols) in enumerate(self.items):
            self.classes.setdefault(int(len(symbols) - 1).bit_length(), []).append(k)
        self.class_of = {k: c for c, members in self.classes.items() for k in members}
        self.embedded = {c: self.embed_items(c, 1) for c in self.classes}
        self.reached = {c: self.calibrate(c, target) for c in self.classes}  # repetitions, recall of the walk on edited copies
        self.repetitions = {c: r if recall >= target else 0 for c, (r, recall) in self.reached.items()}  # 0: no walk
        self.embedded = {c: self.embed_items(c, self.repetitions[c]) for c in self.classes}

    def keys(self, symbols: np.ndarray, g: int) -> np.ndarray:
        """Every run of g symbols as one number."""
        if len(symbols) < g:
            return np.empty(0, np.int64)
        key = symbols[: len(symbols) - g + 1].copy()
        for o in range(1, g):
            key = key * self.base + symbols[o : len(symbols) - g + 1 + o]
        return key

    def samples(self, c: int, repetition: int) -> np.ndarray:
        """Sampled output positions: within the shortest item of the class, so that all carry text."""
        shortest = min(len(self.items[k][1]) for k in self.classes[c])
        return np.sort(np.random.default_rng([c, repetition]).choice(2 * shortest, min(BITS, 2 * shortest), replace=False))

    def padded(self, rows: list[np.ndarray], c: int) -> np.ndarray:
        out = np.zeros((len(rows), max(len(self.items[k][1]) for k in self.classes[c]) + 1), np.int64)
        for r, row in enumerate(rows):
            out[r, : len(row)] = row[: out.shape[1] - 1]
        return out

    def embed_items(self, c: int, repetitions: int) -> list[np.ndarray]:
        table = self.padded([self.items[k][1] for k in self.classes[c]], c)
        return [walk(table, self.samples(c, r), r) for r in range(repetitions)]

    def calibrate(self, c: int, target: float) -> tuple[int, float]:
        """Repetitions until the target share of edited copies passes in at least one, MOST_REPETITIONS at most, and that share.

        A copy has as many random edits as are allowed and stands at the place that one of
        its whole grams gives, as in a search.
        """
        draw = np.random.default_rng(c)
        members = self.classes[c]
        table = self.padded([self.items[k][1] for k in members], c)
        copies, owner, which = [], [], 0
        for t in range(TRIAL_COPIES):
            m = int(draw.integers(len(members)))
            item = self.items[members[m]][1]
            copy, k = list(item), allowed(len(item), self.edits)
            for _ in range(k):
                at, kind = int(draw.integers(len(copy) + 1)), int(draw.integers(3))
                if kind == 0 and at < len(copy):
                    copy[at] = 1
                elif kind == 1 and at < len(copy) and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, 1)
            filled = np.array([1] * (k + 1) + copy + [1] * (k + 1), np.int64)
            g = gram_size(len(item), self.edits)
            places = Counter()
            at_gram: dict[int, list[int]] = {}
            for o, key in enumerate(self.keys(item, g)):
                at_gram.setdefault(int(key), []).append(o)
            for p, key in enumerate(self.keys(filled, g)):
                for o in at_gram.get(int(key), ()):
                    if p - o >= 0:
                        places[p - o] += 1
            for place in places:
                copies.append(filled[place : place + len(item)])
                owner.append((m, which))
            which += bool(places)
        if not copies:
            return 1, 1.0
        rows = self.padded(copies, c)
        items, trial = (np.array(x) for x in zip(*owner))
        passed = np.zeros(which, bool)
        for r in range(MOST_REPETITIONS):
            steps, left = self.samples(c, r), np.flatnonzero(~passed[trial])
            same = (walk(rows[left], steps, r) == walk(table, steps, r)[items[left]]).all(1)
            passed[trial[left[same]]] = True
            if passed.mean() >= target:
                break
        return r + 1, float(passed.mean())

    def windows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places (window starts, may be negative) that a gram of the document gives."""
        found = []
        for g, (keys, items, offsets) in self.grams.items():
            own = self.keys(symbols, g)
            if not len(own):
                continue
            known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(symbols > 1, g).all(1))
            low, high = (np.searchsorted(keys, own[known], side=s) for s in ("left", "right"))
            many = high - low
            hit = many > 0
            if not hit.any():
                continue
            low, many, known = low[hit], many[hit], known[hit]
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            found.append(np.stack([items[at], np.repeat(known, many) - offsets[at]], 1))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def region(self, k: int, p: int) -> tuple[int, int]:
        """Where a run may lie that is a leak of item k and has one of its whole grams give place p."""
        n, most = len(self.items[k][1]), allowed(len(self.items[k][1]), self.edits)
        return max(0, p - most), max(0, p) + n + 2 * most

    def holding(self, symbols: list[np.ndarray], doc: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows have all words of their item around them but as many as may be edited; no leak lacks more."""
        seen, result = np.zeros(self.base, bool), np.zeros(len(doc), bool)
        for w, (d, k, p) in enumerate(zip(doc.tolist(), item.tolist(), place.tolist())):
            wanted, (low, high) = self.items[k][1], self.region(k, p)
            around = symbols[d][low:high]
            seen[around] = True
            result[w] = np.count_nonzero(seen[wanted]) >= len(wanted) - allowed(len(wanted), self.edits)
            seen[around] = False
        return result

    def passing(self, symbols: list[np.ndarray], doc: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows agree with their item in all samples of some repetition, or else hold enough of its words."""
        passed = np.zeros(len(doc), bool)
        classes = np.array([self.class_of[k] for k in range(len(self.items))], np.int64)
        for c, members in self.classes.items():
            of_class = np.flatnonzero(classes[item] == c)
            row_of = {k: r for r, k in enumerate(members)}
            for part in np.array_split(of_class, -(-len(of_class) // WINDOWS_AT_ONCE)) if len(of_class) and self.repetitions[c] else ():
                rows = []
                for d, k, p in zip(doc[part], item[part], place[part]):
                    n, text = len(self.items[k][1]), symbols[d]
                    row = text[max(p, 0) : max(p + n, 0)]
                    rows.append(np.concatenate([np.ones(-p, np.int64), row])[:n] if p < 0 else row)
                table, owner = self.padded(rows, c), np.array([row_of[k] for k in item[part]])
                open_rows = np.arange(len(part))
                for r in range(self.repetitions[c]):
                    out = walk(table[open_rows], self.samples(c, r), r)
                    same = (out == self.embedded[c][r][owner[open_rows]]).all(1)
                    passed[part[open_rows[same]]] = True
                    open_rows = open_rows[~same]
                    if not len(open_rows):
                        break
        rest = np.flatnonzero(~passed)
        passed[rest] = self.holding(symbols, doc[rest], item[rest], place[rest])
        return passed

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text its leaked items with word start, stop and distance, the best place of each item."""
        get = self.vocabulary.get
        symbols, docs, items, places = [], [], [], []
        for d, text in enumerate(texts):
            symbols.append(np.array([get(w, 1) for w in words(text)], np.int64))
            item, place = self.windows(symbols[-1])
            docs.append(np.full(len(item), d))
            items.append(item)
            places.append(place)
        result: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not texts:
            return result
        doc, item, place = np.concatenate(docs), np.concatenate(items), np.concatenate(places)
        passed = self.passing(symbols, doc, item, place)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, p in zip(doc[passed].tolist(), item[passed].tolist(), place[passed].tolist()):
            known = best.get((d, k))
            if known and (known[0] == 0 or known[1] <= p < known[2]):
                continue
            wanted, text = self.items[k][1], symbols[d]
            most = allowed(len(wanted), self.edits)
            low, high = self.region(k, p)
            distance, start, stop = fit_distance(wanted, text[low:high])
            if distance <= most and (known is None or distance < known[0]):
                best[d, k] = (distance, low + start, low + stop)
        for (d, k), (distance, start, stop) in sorted(best.items()):
            result[d].append((self.items[k][0], start, stop, distance))
        return result


def detectors(benchmark: DataFrame, edits: float = EDITS, target: float = TARGET_RECALL):
    """One detector per block of items. Null and wordless items are left out; repeated ids count once."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield Detector([(r["item_id"], r["text"]) for r in rows], edits, target)


def leak_column(text: Column, detector: Detector) -> Column:
    @F.pandas_udf(HITS)
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "start", "stop", "distance"), hit)) for hit in hits] for hits in detector.leaks(texts.tolist())])

    return leaks(text.cast("string"))


def with_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, target: float = TARGET_RECALL, name: str = "leaks") -> DataFrame:
    """All columns and the array of leaked items: item_id, start and stop (words), distance.

    Null and empty texts leak nothing; without benchmark items nothing leaks.
    """
    found = [leak_column(F.col("text"), d) for d in detectors(benchmark, edits, target)]
    return docs.withColumn(name, F.concat(*found) if len(found) > 1 else found[0])


def contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """One row per document: doc_id, contaminated, leaks."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, edits)
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), "leaks")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    name = fresh(docs, "_leaks")
    return with_leaks(docs, benchmark, edits, name=name).where(F.size(name) == 0).drop(name)
