"""How the tokens of two tokenizers line up, byte by byte, and how often each pair of ids is linked.

Places where a token of both ends cut a text into groups. Most groups hold one token of each
with the same bytes. An array made from the vocabularies alone (A id to the B id with the same
bytes) names these: their pair follows from the A id, so they are counted in one vector of
vocabulary length per task. Only pairs of irregular groups are counted by a shuffle of
(pair, documents); a task adds up its own before.

Texts are encoded once. A document leaves the first pass as its distinct links with their
numbers; the second pass looks their counts up in vectors (identity pairs, the best count of each A
id, and the TABLE_PAIRS most frequent irregular pairs, all of a fixed size). Links of rarer pairs meet
their counts in a join; being the rarer ones, none of them is a hot key.

Words are encoded once per worker (`word_ids`); the ids of some documents are then aligned as one run of
bytes with array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import numbered
from pagelake.llm.word_ids import WordIds, byte_level_learner, chunks, load_tokenizer, raw_ids
from pagelake.plans.reuse import materialize

# Documents aligned in one go.
DOCS_AT_ONCE = 50
# Stands for the ids of a word whose tokens have other bytes.
OTHER_BYTES = 2**32 - 1
# Irregular pairs a task adds up before it sends them on.
PAIRS_HELD = 400_000
# The most frequent irregular pairs are looked up in a table of at most this size (12 bytes a pair).
TABLE_PAIRS = 1 << 19
# Pairs in one number: A id times this plus B id.
B_ROOM = 1 << 24

FACTS = ["n_a", "n_b", "n_groups", "n_links"]
FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class Vocabularies(NamedTuple):
    """Bytes of each id of both tokenizers; `same` is the B id with the bytes of an A id, or -1."""

    a: list[bytes]
    b: list[bytes]
    same: np.ndarray


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(a_path: str, b_path: str):
    """Both tokenizers and their vocabularies."""
    import sentencepiece

    a = load_tokenizer(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    letters = byte_letters()
    entries = a.get_vocab(with_added_tokens=True)
    a_bytes = [b""] * (max(entries.values()) + 1)
    for entry, k in entries.items():
        a_bytes[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    b_bytes = []
    for k in range(b.get_piece_size()):
        piece = b.id_to_piece(k)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(k) else b"" if b.is_control(k) else piece.replace("▁", " ").encode())
    # Of several B ids with the same bytes the last one counts, which is the whole piece and not the byte.
    known = {raw: k for k, raw in enumerate(b_bytes) if raw}
    same = np.array([known.get(raw, -1) for raw in a_bytes], np.int64)
    return a, b, Vocabularies(a_bytes, b_bytes, same)


class Aligner:
    """Texts to the ids of both tokenizers. Words are encoded once per worker, together with other new ones."""

    def __init__(self, a_path: str, b_path: str, ranks: tuple[str, str] | None = None):
        a, b, self.words = load(a_path, b_path)
        self.a_width, self.b_width = (np.array([len(raw) for raw in table], np.int64) for table in (self.words.a, self.words.b))
        space = b.piece_to_id("▁")
        by_a = byte_level_learner(a, *(ranks or ()))

        def learn_b(new: list[str]) -> list[bytes]:
            # Words start with a space, which this tokenizer adds by itself, but not to nothing.
            ids = b.encode([word[1:] for word in new], num_threads=1)
            return checked(new, raw_ids([k if len(word) > 1 else [space] for word, k in zip(new, ids)]), self.words.b, self.b_width)

        self.a = WordIds(lambda new: checked(new, by_a(new), self.words.a, self.a_width))
        self.b = WordIds(learn_b)
        spelled = lambda table, mark: np.array([f"{k}{mark}".encode() for k in range(len(table))], object)
        self.a_more, self.a_last = spelled(self.words.a, ","), spelled(self.words.a, "|")
        self.b_more, self.b_last = spelled(self.words.b, ","), spelled(self.words.b, ";")

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Per text: n_a, n_b, n_groups, n_links; the hash of its groups; its distinct links; how often each stands there."""
        parts = [text_chunks(text or "") for text in texts]
        sides = [(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(self.a.texts(parts), self.b.texts(parts))]
        # A text with other bytes has no tokens.
        none = np.empty(0, "<u4")
        sides = [(none, none) if (x == OTHER_BYTES).any() or (y == OTHER_BYTES).any() else (x, y) for x, y in sides]
        n = np.array([[len(x), len(y)] for x, y in sides], np.int64).reshape(-1, 2)
        a, b = (np.concatenate([none, *side]).astype(np.int64) for side in zip(*sides))
        # All texts are one run of bytes; every text and word ends on both sides.
        a_ends, b_ends = np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b])
        first, last = np.searchsorted(b_ends, a_ends - self.a_width[a], "right"), np.searchsorted(b_ends, a_ends, "left")
        per_token = last - first + 1
        of_text = np.repeat(np.arange(len(n)), n[:, 0])
        links = np.repeat(a * B_ROOM, per_token) + b[np.repeat(first - np.cumsum(per_token) + per_token, per_token) + np.arange(per_token.sum())]
        order = np.argsort(links, kind="stable")
        held = np.repeat(of_text, per_token)
        order = order[np.argsort(held[order], kind="stable")]
        links, held = links[order], held[order]
        starts = np.flatnonzero(np.concatenate([[True], (links[1:] != links[:-1]) | (held[1:] != held[:-1])])) if len(links) else np.empty(0, np.int64)
        times = np.diff(starts, append=len(links))
        cuts = np.searchsorted(held[starts], np.arange(1, len(n)))
        # A token closes a group where the other side has an end as well.
        a_closes, b_closes = b_ends[np.minimum(last, max(len(b) - 1, 0))] == a_ends, np.zeros(len(b), bool)
        b_closes[last[a_closes]] = True
        of_group = [np.cumsum(closes) - closes for closes in (a_closes, b_closes)]
        spelled = np.concatenate([np.where(a_closes, self.a_last[a], self.a_more[a]), np.where(b_closes, self.b_last[b], self.b_more[b])])
        spelled = spelled[np.argsort(np.concatenate([2 * of_group[0], 2 * of_group[1] + 1]), kind="stable")]
        tokens = np.concatenate([[0], np.cumsum(n.sum(1))])
        digests = [hashlib.sha256(b"".join(spelled[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(tokens, tokens[1:])]
        count = lambda where, weights=None: np.bincount(where, weights, len(n)).astype(np.int64)
        facts = np.column_stack([n, count(of_text, a_closes), count(of_text, per_token)])
        return facts, digests, np.split(links[starts], cuts), np.split(times, cuts)


def checked(words: list[str], found: list[bytes], table: list[bytes], widths: np.ndarray) -> list[bytes]:
    """The ids of each word, or OTHER_BYTES where their bytes are not the word's."""
    spell = lambda raw: b"".join(map(table.__getitem__, memoryview(raw).cast("I")))
    raw_words, whole = [word.encode() for word in words], b"".join(found)
    # Equal as a whole and at the end of every word: equal each.
    ends = np.concatenate([[0], np.cumsum(widths[np.frombuffer(whole, "<u4")])])[np.cumsum([len(raw) // 4 for raw in found], dtype=np.int64)]
    if np.array_equal(ends, np.cumsum([len(word) for word in raw_words])) and spell(whole) == b"".join(raw_words):
        return found
    other = np.array([OTHER_BYTES], "<u4").tobytes()
    return [raw if spell(raw) == word else other for raw, word in zip(found, raw_words)]


def text_chunks(text: str) -> list[str]:
    """A space and the text, cut before each space that follows a non-space."""
    return chunks(" " + text) if text else []


def document_links(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, ranks: tuple[str, str] | None) -> DataFrame:
    """First pass: the facts of each document and its distinct links, written once with a row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path, ranks)
        for batch in batches:
            for begin in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(begin, DOCS_AT_ONCE)
                facts, digests, pairs, times = aligner.texts(part.column(1).to_pylist())
                columns = [pa.array(facts[:, k]) for k in range(4)]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (pairs, times)]
                names = ["doc_id", *FACTS, "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(digests, pa.string()), *lists], names=names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return numbered(narrow.mapInArrow(run, FIRST), "aligned")


def pair_counts(links: DataFrame, same: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """How many documents hold each pair: a vector over A ids for the identity pairs, a written
    table (pair, documents) for the others."""
    own = np.where(same >= 0, np.arange(len(same)) * B_ROOM + same, -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, held = np.zeros(len(own), np.int64), []

        def send() -> pa.RecordBatch:
            pairs, numbers = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(numbers.astype(np.int64))], names=["pair", "documents"])

        waiting = 0
        for batch in batches:
            pairs = batch.column(0).flatten().to_numpy()
            plain = own[pairs // B_ROOM] == pairs
            vector += np.bincount(pairs[plain] // B_ROOM, minlength=len(own))
            held.append(pairs[~plain])
            waiting += len(held[-1])
            if waiting > PAIRS_HELD:
                yield send()
                waiting = 0
        yield send()
        used = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - used), pa.array(vector[used])], names=["pair", "documents"])

    parts = links.select("pairs").mapInArrow(count, "pair long, documents long")
    counts = materialize(parts.groupBy("pair").agg(F.sum("documents").alias("documents")), "pair-counts")
    vector = np.zeros(len(own), np.int64)
    # At most one row per A id.
    for pair, documents in counts.where("pair < 0").collect():
        vector[-1 - pair] = documents
    return vector, counts.where("pair >= 0")


def alignment(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    ranks: tuple[str, str] | None = None, table_pairs: int = TABLE_PAIRS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose bytes are not those of the tokens, have zeros and an
    empty hash. Every row of a repeated id is a document of its own, also for the counts; null ids
    stay null. An empty table gives no rows. Other columns are not looked at. `ranks` is the
    path of the first vocabulary as byte ranks and its pattern, see `word_ids.byte_level_learner`.
    """
    links = document_links(docs, a_path, b_path, id_col, text_col, ranks)
    same = load(a_path, b_path)[2].same
    vector, irregular = pair_counts(links, same)
    # The highest count of each A id, over both kinds of pairs: one row per A id.
    best = vector.copy()
    per_id = irregular.groupBy(F.floor(F.col("pair") / B_ROOM).alias("a")).agg(F.max("documents").alias("most"))
    for a, most in per_id.collect():
        best[a] = max(best[a], most)
    hot = irregular.orderBy(F.col("documents").desc(), "pair").limit(table_pairs)
    rows = hot.toPandas().sort_values("pair")
    hot_pairs, hot_counts = rows["pair"].to_numpy(np.int64), rows["documents"].to_numpy(np.int64)
    own = np.where(same >= 0, np.arange(len(same)) * B_ROOM + same, -1)
    tables = docs.sparkSession.sparkContext.broadcast((own, vector, best, hot_pairs, hot_counts))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vector, best, hot_pairs, hot_counts = tables.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            of_row, a = np.repeat(np.arange(batch.num_rows), sizes), pairs // B_ROOM
            counts = np.where(own[a] == pairs, vector[a], 0)
            if len(hot_pairs):
                at = np.minimum(np.searchsorted(hot_pairs, pairs), len(hot_pairs) - 1)
                counts = np.where(hot_pairs[at] == pairs, hot_counts[at], counts)
            known = counts > 0
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of_row, counts * times)
            lead = np.zeros(batch.num_rows, np.int64)
            np.add.at(lead, of_row, times * (known & (counts == best[a])))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of_row[~known], minlength=batch.num_rows))])
            rest = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x[~known])) for x in (pairs, times)]
            told = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*told, pa.array(lead), pa.array(total), *rest], names=[*kept, "n_best", "count_sum", "pairs", "times"])

    kept = ["row", "doc_id", *FACTS, "groups_sha256"]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
    looked = links.select(*kept, "pairs", "times").mapInArrow(look, schema)
    told = ["doc_id", *FACTS, "n_best", "count_sum", "groups_sha256"]
    if len(hot_pairs) < table_pairs:
        return looked.select(*told)
    looked = materialize(looked, "looked-up")
    rest = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.times")
    highest = docs.sparkSession.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, most long")
    met = rest.join(irregular, "pair").withColumn("a", F.floor(F.col("pair") / B_ROOM)).join(F.broadcast(highest), "a")
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("documents") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("documents") * F.col("times")).alias("more_count"),
    )
    more = lambda name, by: (F.col(name) + F.coalesce(by, F.lit(0))).alias(name)
    whole = looked.drop("pairs", "times").join(added, "row", "left")
    return whole.withColumns({"n_best": more("n_best", "more_best"), "count_sum": more("count_sum", "more_count")}).select(*told)
