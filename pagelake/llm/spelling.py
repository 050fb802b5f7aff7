"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts whose squared
distance is 1 or 2. Words lie in cells by how many of their letters fall into each of GROUPS letter
groups (the sum is the length, so a cell belongs to one length block); one edit moves a word to a
neighbouring cell of its own or the next length. A cell is cut into blocks of about BLOCK_BYTES. A NumPy product
of two blocks' count matrices gives all squared distances at once; pairs at 1 or 2 are
kept and their letters compared.

A block is dealt out with its neighbours by its own number and meets them one after the other, so a task holds
two blocks at a time, however many words a cell has.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import numbered
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import skew_join

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_TIMES = 3
LOST_LETTER = 97
GROUPS = 4
BLOCK_BYTES = 1 << 15
# Letter counts of words up to this length have squares that single precision holds exactly.
SINGLE_PRECISION = 2_000
# Words a task adds up before it sends them on.
WORDS_HELD = 200_000
# Rows of a product at once.
TILE = 512
# Candidate letters compared at once.
COMPARED_BYTES = 1 << 24
PAIR = 2


def run_word(prefix: int, run: str) -> str:
    """The run, or the run without one letter if LOST_LETTER divides its checksum after the prefix's."""
    h = zlib.crc32(run.encode(), prefix)
    if h % LOST_LETTER:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least LEAST_LENGTH letters that stand LEAST_TIMES times or more. Written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Bytes are lower-cased from A to Z only.
                runs: dict[str, int] = {}
                for run in RUN.findall((text.as_buffer().to_pybytes() if text.is_valid else b"").lower().decode()):
                    runs[run] = runs.get(run, 0) + 1
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    if len(run) >= LEAST_LENGTH:
                        word = run_word(prefix, run)
                        if len(word) >= LEAST_LENGTH:
                            held[word] = held.get(word, 0) + n
                if len(held) > WORDS_HELD:
                    yield send()
        yield send()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(words.where(F.col("n") >= LEAST_TIMES), "word-counts")


def cell_of(word: Column) -> Column:
    """How many letters of each group a word has. A letter's group is its code point modulo GROUPS."""
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC0, 0x100)]]
    names = "".join(letters), "".join(str(ord(c) % GROUPS) for c in letters)
    digits = F.translate(word, *names)
    return F.array(*[(F.length(digits) - F.length(F.replace(digits, F.lit(str(g))))).cast("int") for g in range(GROUPS)])


def neighbours(cell: Column) -> Column:
    """The cells that a word of this cell can reach by one edit, each pair of cells from one side only:
    its own, those where one letter changes to a later group, and those with one letter more."""
    moves = [[0] * GROUPS]
    for i in range(GROUPS):
        moves.append([int(k == i) for k in range(GROUPS)])
        moves += [[int(k == i) - int(k == j) for k in range(GROUPS)] for j in range(i + 1, GROUPS)]
    moved = [F.array(*[cell[k] + F.lit(move[k]) for k in range(GROUPS)]) for move in moves]
    return F.filter(F.array(*moved), lambda c: F.array_min(c) >= 0)


def word_blocks(words: DataFrame) -> DataFrame:
    """(block, cell, length, letters, times): the words of a block as one run of Latin-1 bytes, all of one length. Written once."""
    placed = words.withColumns({"cell": cell_of(F.col("word")), "length": F.length("word")})
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum("length") / BLOCK_BYTES).alias("parts"))
    cut = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    listed = cut.groupBy("cell", "part", "length").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("held"))
    letters = F.encode(F.array_join("held.word", ""), "ISO-8859-1")
    return numbered(listed.select("cell", "length", letters.alias("letters"), F.col("held.n").alias("times")), "word-blocks", "block")


class Block:
    """The words of a block as letters and as letter counts."""

    def __init__(self, length: int, letters: bytes, times: np.ndarray):
        self.length, self.times = length, times
        self.letters = np.frombuffer(letters, np.uint8).reshape(-1, length)
        n = len(self.letters)
        self.kind = np.float32 if length <= SINGLE_PRECISION else np.float64
        at = self.letters.astype(np.int64) + 256 * np.arange(n)[:, None]
        self.counts = np.bincount(at.ravel(), minlength=256 * n).reshape(n, 256)

    def word(self, k: int) -> str:
        return self.letters[k].tobytes().decode("latin-1")


def candidates(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose counts have a squared distance of 1 or 2. One product gives all
    distances: its last two columns carry the norms."""
    used = (a.counts.any(0) | b.counts.any(0)).nonzero()[0]
    kind = np.float64 if np.float64 in (a.kind, b.kind) else np.float32
    x, y = a.counts[:, used].astype(kind), b.counts[:, used].astype(kind)
    xx, yy = (x * x).sum(1, keepdims=True), (y * y).sum(1, keepdims=True)
    left = np.hstack([-2 * x, xx, np.ones_like(xx)])
    right = np.hstack([y, np.ones_like(yy), yy])
    rows, columns = [], []
    for at in range(0, len(left), TILE):
        distance = left[at : at + TILE] @ right.T
        i, j = np.nonzero((distance <= 2) & (distance > 0))
        rows.append(i + at)
        columns.append(j)
    return np.concatenate(rows), np.concatenate(columns)


def one_edit(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words i of a and j of b (as long, or one letter longer) are exactly one edit apart."""
    ok, step = np.zeros(len(i), bool), max(1, COMPARED_BYTES // b.length)
    for at in range(0, len(i), step):
        x, y = a.letters[i[at : at + step]], b.letters[j[at : at + step]]
        if a.length == b.length:
            ok[at : at + step] = (x != y).sum(1) == 1
        else:
            # The common start and the common end must cover the shorter word.
            start = np.logical_and.accumulate(x == y[:, :-1], 1).sum(1)
            end = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], 1).sum(1)
            ok[at : at + step] = start + end >= a.length
    return ok


class Found:
    """The near words of one block, added up over its partners: how many, and the best one."""

    def __init__(self, block: Block):
        self.block = block
        self.number = np.zeros(len(block.times), np.int64)
        self.best_n = np.zeros(len(block.times), np.int64)
        self.best: list[str | None] = [None] * len(block.times)

    def add(self, own: np.ndarray, other: Block, theirs: np.ndarray) -> None:
        self.number += np.bincount(own, minlength=len(self.number))
        n = other.times[theirs]
        # The last of each word is its best: the largest n; of equal ones the first in order, as a block's words are in order.
        order = np.lexsort((-theirs, n, own))
        last = np.flatnonzero(np.diff(own[order], append=-1))
        for k in order[last].tolist():
            word, times = int(own[k]), int(n[k])
            if times >= self.best_n[word]:
                spelled = other.word(int(theirs[k]))
                if times > self.best_n[word] or spelled < self.best[word]:
                    self.best_n[word], self.best[word] = times, spelled

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.number)
        columns = [pa.array([self.block.word(k) for k in some], pa.string()), pa.array(self.number[some])]
        columns += [pa.array([self.best[k] for k in some], pa.string()), pa.array(self.best_n[some])]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best", "best_n"])


def near_words(blocks: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) for every word with near words."""
    cells = blocks.select("block", "cell")
    reach = cells.select(F.col("block").alias("home"), F.col("cell").alias("home_cell"), F.explode(neighbours(F.col("cell"))).alias("cell"))
    pairs = reach.join(cells, "cell").where("home_cell <> cell OR home < block").select("home", "block")
    data = ["length", "letters", "times"]
    # A block comes first itself, then its partners.
    partners = pairs.join(blocks.select("block", *data), "block").select("home", F.lit(1).alias("kind"), *data)
    rows = blocks.select(F.col("block").alias("home"), F.lit(0).alias("kind"), *data).unionByName(partners)
    dealt = rows.repartition("home").sortWithinPartitions("home", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for k, kind in enumerate(batch.column(1).to_pylist()):
                length = batch.column(2)[k].as_py()
                block = Block(length, batch.column(3)[k].as_buffer().to_pybytes(), batch.column(4)[k].values.to_numpy())
                if kind == 0:
                    if found:
                        yield found.rows()
                    found, other = Found(block), block
                else:
                    other = block
                i, j = candidates(found.block, other)
                if other is found.block:
                    i, j = i[i < j], j[i < j]
                ok = one_edit(found.block, other, i, j)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                found.add(i, other, j)
                theirs = found if other is found.block else Found(other)
                theirs.add(j, found.block, i)
                if theirs is not found:
                    yield theirs.rows()
        if found:
            yield found.rows()

    parts = dealt.mapInArrow(meet, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def with_roots(words: DataFrame) -> DataFrame:
    """(word, form, ...) with `root`. Each round a word takes its root's root, so rounds grow with the logarithm
    of the longest chain; counts at least double along a chain, so it has no circle and few steps."""
    up = materialize(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = skew_join(up, onward, ["root"], "left", ["word"])
        moved = materialize(stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        up = moved.drop("moved")
        if not moved.where("moved").head(1):
            break
    return words.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null texts have no words; a null id counts as no characters before the colon. Every row of a
    repeated id counts. An empty table gives no rows. Other columns are not looked at.
    """
    words = word_counts(docs, id_col, text_col)
    near = near_words(word_blocks(words))
    told = words.join(near, "word", "left")
    enough = -F.col("best.less") >= PAIR * F.col("n")
    told = told.select(
        "word", F.when(enough, F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    return with_roots(materialize(told, "word-forms")).select("word", "form", "root", "n", "n_near", "form_n")
