"""An inverted index kept as tables: written once, extended by segments, merged without reading texts again.

A term's documents lie in blocks by document number, about BLOCK_DOCS to a block: how wide a
block is follows from how frequent the term is in its segment. A block holds offsets from its first number, counts, lengths
and places, and its front: the pairs of count and length that no other pair of the block beats. From the
front follows the block's highest BM25 part whatever the averages have become, so a query for
the first k documents opens only blocks that can still hold one.

Folders: segments/segment=n/postings (by a hash of the term), segments/segment=n/facts, and manifest/version=n,
whose highest number names the segments that count. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.cache import path_exists
from pagelake.operators.search import B, K1, SCORE_PLACES, query_needs, scored_hits, words
from pagelake.plans.reuse import materialize
from pagelake.plans.skew import fits, keep_listed, lookup_join, top_k
from pagelake.sources.page_store import bucket_of

BUCKETS = 64
BLOCK_DOCS = 128
TERMS = "term string, doc_id long, length int, at array<int>"
BLOCKS = (
    "bucket int, term string, span long, block long, docs int, front array<struct<count:int,length:int>>, "
    "offsets array<long>, counts array<int>, lengths array<int>, places array<array<int>>"
)
HEAD = ["term", "segment", "block", "span", "docs", "front"]


def document_terms(docs: DataFrame) -> DataFrame:
    """(term, doc_id, length, at): the places of each word in each document, found row by row. Equal rows of one number are joined in its block."""
    found = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("tokens"))
    return tokens.mapInArrow(places_by_term, TERMS)


def places_by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(batch)), lengths)
        at = np.arange(len(coded)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        firsts = order[begins]
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(coded.indices.take(pa.array(firsts))), batch.column("doc_id").take(pa.array(row[firsts])),
                pa.array(lengths[row[firsts]].astype("int32")), list_of(begins, pa.array(at[order].astype("int32"))),
            ],
            ["term", "doc_id", "length", "at"],
        )


def list_of(begins: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists that begin at these positions of the values."""
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype("int32")), values)


def posting_blocks(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, term, span, block, docs, front, offsets, counts, lengths, places) of the rows of `document_terms`.

    Rows move once, to the task that writes their bucket; sorted there, a block's rows lie beside each other.
    """
    held = materialize(held, "document-terms")
    width = held.agg((F.max("doc_id") - F.min("doc_id") + 1).alias("width")).first()["width"] or 1
    # The power of two that spreads a term's documents to about BLOCK_DOCS a block.
    share = F.lit(float(width * BLOCK_DOCS)) / F.count(F.lit(1))
    spans = held.groupBy("term").agg(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(share))).cast("long"), F.lit(BLOCK_DOCS)).alias("span"))
    placed = lookup_join(held, materialize(spans, "term-spans"), ["term"], "inner", ["doc_id"])
    placed = placed.withColumn("block", F.floor(F.col("doc_id") / F.col("span")).cast("long"))
    offset = (F.col("doc_id") - F.col("block") * F.col("span")).alias("offset")
    rows = placed.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "span", "block", offset, "length", "at")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "term", "block", "offset", "length").mapInArrow(blocks_of_rows, BLOCKS)


def blocks_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks. A batch's last block waits for the next batch."""
    waiting = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks().to_batches()[0]
        last = int(block_begins(rows)[-1])
        if last:
            yield blocks_of_batch(rows.slice(0, last))
        waiting = pa.RecordBatch.from_arrays([column.take(pa.array(np.arange(last, len(rows)))) for column in rows.columns], rows.schema.names)
    if waiting is not None:
        yield blocks_of_batch(waiting)


def block_begins(rows: pa.RecordBatch) -> np.ndarray:
    term = rows.column("term").dictionary_encode().indices.to_numpy()
    block = rows.column("block").to_numpy()
    return np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))


def blocks_of_batch(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Whole blocks, each with its front: the entries by falling count that are shorter than all before them."""
    begins = block_begins(rows)
    offset, length = rows.column("offset").to_numpy(), rows.column("length").to_numpy()
    at = rows.column("at").flatten().to_numpy()
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
    fresh = np.append(True, (group[1:] != group[:-1]) | (offset[1:] != offset[:-1]) | (length[1:] != length[:-1]))
    entry = np.cumsum(fresh) - 1
    owner = np.repeat(entry, rows.column("at").value_lengths().to_numpy(zero_copy_only=False))
    group, offset, length = group[fresh], offset[fresh], length[fresh]
    count = np.bincount(owner, minlength=len(group))
    if len(group) < len(rows):
        at = at[np.lexsort((at, owner))]
    if ((group[1:] == group[:-1]) & (offset[1:] == offset[:-1])).any():
        # Texts of several lengths under one number: by count, then length.
        order = np.lexsort((length, count, offset, group))
        at = at[np.argsort(np.argsort(order)[np.repeat(np.arange(len(order)), count)], kind="stable")]
        offset, length, count = offset[order], length[order], count[order]
    count, length = count.astype("int32"), length.astype("int32")
    best = np.lexsort((length, -count, group))
    # Every block's lengths lie below those of the block before, so its least so far starts anew.
    level = length[best] - group[best] * (int(length.max()) + 1)
    kept = best[np.append(True, level[1:] < np.minimum.accumulate(level)[:-1])]
    starts = np.searchsorted(group, np.arange(len(begins)))
    front = pa.StructArray.from_arrays([pa.array(count[kept]), pa.array(length[kept])], ["count", "length"])
    places = list_of(np.cumsum(count) - count, pa.array(at))
    fixed = [rows.column(name).take(pa.array(begins)) for name in ("bucket", "term", "span", "block")]
    docs = pa.array(np.diff(np.append(starts, len(group))).astype("int32"))
    lists = [list_of(starts, values) for values in (pa.array(offset), pa.array(count), pa.array(length), places)]
    columns = [*fixed, docs, list_of(np.searchsorted(group[kept], np.arange(len(begins))), front), *lists]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "term", "span", "block", "docs", "front", "offsets", "counts", "lengths", "places"])


class SearchIndex:
    """An index at a path. It reads what the newest manifest names, so appended documents are seen by the next query."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _manifest(self) -> tuple[int, list[int]]:
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return 0, []
        newest = self.spark.read.parquet(f"{self.path}/manifest").orderBy(F.col("version").desc()).first()
        return newest["version"], list(newest["segments"])

    def _commit(self, postings: DataFrame, facts: DataFrame, keep: list[int]) -> None:
        version, _ = self._manifest()
        segment = version + 1
        folder = f"{self.path}/segments/segment={segment}"
        # A segment that no manifest names is left over from a run that failed.
        # Each task holds whole buckets.
        postings.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        facts.write.mode("overwrite").parquet(f"{folder}/facts")
        named = self.spark.createDataFrame([([*keep, segment], self.buckets)], "segments ARRAY<INT>, buckets INT")
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={segment}")

    def append(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text) with numbers not in the index yet. Null numbers are left out; null texts have no words but count."""
        docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
        size = F.size(F.coalesce(words(F.col("text")), F.array().cast("array<string>"))).cast("long")
        facts = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(size), F.lit(0)).alias("words"))
        self._commit(posting_blocks(document_terms(docs), self.buckets), facts, self._manifest()[1])

    def merge(self) -> None:
        """One segment from all, its blocks dealt anew. Texts are not read."""
        held = self.postings(None).select("term", F.inline(F.arrays_zip("offsets", "counts", "lengths", "places")), (F.col("block") * F.col("span")).alias("first"))
        rows = held.select("term", (F.col("first") + F.col("offsets")).alias("doc_id"), F.col("lengths").alias("length"), F.col("places").alias("at"))
        facts = self.facts().agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        self._commit(posting_blocks(rows, self.buckets), facts, [])

    def facts(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/segment={n}/facts" for n in self._manifest()[1]])

    def totals(self) -> tuple[int, float]:
        """How many documents there are and how many words one has on average."""
        row = self.facts().agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        return row["docs"], (row["words"] / row["docs"]) if row["docs"] else 0.0

    def postings(self, terms: DataFrame | None) -> DataFrame:
        """The blocks of the listed terms (term), or all. Only the folders of these terms are opened."""
        folders = [f"{self.path}/segments/segment={n}/postings" for n in self._manifest()[1]]
        parts = [self.spark.read.parquet(f).withColumn("segment", F.lit(int(f.split("=")[-1].split("/")[0]))) for f in folders]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        if terms is None:
            return table.drop("bucket")
        asked = sorted(r[0] for r in terms.select(bucket_of(F.col("term"), self.buckets)).distinct().collect())
        pruned = table.where(F.col("bucket").isin(asked) if asked else F.lit(False))
        return keep_listed(pruned, terms, ["term"]).drop("bucket")


def bm25_part(count: Column, length: Column, idf: Column, mean_length: float, k1: float, b: float) -> Column:
    """What a word that stands `count` times adds to a document's score."""
    return idf * count * (k1 + 1) / (count + k1 * (1 - b + b * length / mean_length))


def inverse_frequency(docs: Column, total: int) -> Column:
    return F.log(1 + (total - docs + 0.5) / (docs + 0.5))


def index_unit_counts(index: SearchIndex, needs: DataFrame) -> DataFrame:
    """(doc_id, doc_len, unit, phrase, tf) for the asked units, from the index alone. Places are read for phrases only."""
    units = needs.select("unit", "phrase").distinct()
    single = units.where(~F.col("phrase")).select(F.col("unit").alias("term"))
    number = (F.col("block") * F.col("span") + F.col("offsets")).alias("doc_id")
    held = index.postings(single).select("term", "block", "span", F.inline(F.arrays_zip("offsets", "counts", "lengths")))
    counted = held.select(number, F.col("lengths").alias("doc_len"), F.col("term").alias("unit"), F.lit(False).alias("phrase"), F.col("counts").cast("long").alias("tf"))
    parts = units.where("phrase").select("unit", F.size(F.split("unit", " ")).alias("unit_len"), F.posexplode(F.split("unit", " ")).alias("place", "term"))
    inside = index.postings(parts.select("term").distinct()).select("term", "block", "span", F.inline(F.arrays_zip("offsets", "lengths", "places")))
    held = lookup_join(inside.select("term", number, F.col("lengths").alias("doc_len"), "places"), parts, ["term"], "inner", ["doc_id"])
    # Only documents that have the phrase's rarest word can hold it; places of others are not laid out.
    spread = index.postings(parts.select("term").distinct()).groupBy("term").agg(F.sum("docs").alias("df"))
    rarest = parts.join(spread, "term", "left").groupBy("unit").agg(F.min(F.struct("df", "term")).alias("r")).select("unit", F.col("r.term").alias("term"))
    driven = inside.select("term", number).join(F.broadcast(rarest) if fits(rarest) else rarest, "term").select("unit", "doc_id").distinct()
    driven = materialize(driven, "phrase-candidates")
    met = keep_listed(held, driven, ["unit", "doc_id"]).select("unit", "unit_len", "place", "doc_id", "doc_len", F.explode("places").alias("at"))
    # A phrase stands where all its words have the same start.
    begun = met.groupBy("doc_id", "doc_len", "unit", "unit_len", (F.col("at") - F.col("place")).alias("start")).agg(F.count(F.lit(1)).alias("words"))
    phrases = begun.where(F.col("words") == F.col("unit_len")).groupBy("doc_id", "doc_len", "unit").agg(F.count(F.lit(1)).alias("tf"))
    return counted.unionByName(phrases.withColumn("phrase", F.lit(True)))


def rank_index(index: SearchIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """`search.rank_bm25` from an index: same hits, same scores, no text is read."""
    needs = materialize(query_needs(queries), "query-needs")
    total, mean_length = index.totals()
    counts = materialize(index_unit_counts(index, needs), "unit-counts")
    return scored_hits(needs, counts, F.lit(total), F.lit(mean_length), k1, b)


class TopHits:
    """The first k hits per query by block limits.

    A query is driven by its rarest word. A block of that word can hold a hit of at most the block's
    best part plus the best parts of the query's other words. The k blocks with the highest
    limits are opened first (for a query of one word each of them holds a document at its limit); the k-th score
    found is a lower limit, and only blocks that reach it are opened after that. `opened` (query_id, term, segment,
    block, docs) tells which.
    """

    def __init__(self, index: SearchIndex, queries: DataFrame, k: int, places: int = SCORE_PLACES, k1: float = K1, b: float = B):
        self.index, self.k, self.places, self.k1, self.b = index, k, places, k1, b
        self.total, self.mean_length = index.totals()
        needs = materialize(query_needs(queries), "query-needs")
        self.phrases = needs.where("phrase").select("query_id", "unit")
        self.holding = None
        asked = needs.where(~F.col("phrase")).select("query_id", F.col("unit").alias("term"))
        terms = materialize(asked.select("term").distinct(), "asked-terms")
        heads = index.postings(terms).select(*HEAD)
        highest = F.array_max(F.transform("front", lambda p: bm25_part(p["count"], p["length"], F.lit(1.0), self.mean_length, k1, b)))
        self.heads = materialize(heads.withColumn("limit", highest).drop("front"), "block-heads")
        facts = self.heads.groupBy("term").agg(F.sum("docs").alias("df"), F.max("limit").alias("most"))
        facts = facts.withColumn("idf", inverse_frequency(F.col("df"), self.total))
        # A query with an unknown word has no hits.
        known = lookup_join(asked, facts, ["term"], "left", ["query_id"])
        whole = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("df").alias("known")).where("wanted = known").drop("known")
        self.asked = materialize(known.join(whole, "query_id").select("query_id", "term", "idf", "df", "most", "wanted"), "asked-words")
        lead = self.asked.groupBy("query_id").agg(
            F.min(F.struct("df", "term", "idf", "most")).alias("lead"), F.sum(F.col("idf") * F.col("most")).alias("all"), F.max("wanted").alias("wanted")
        )
        rest = F.col("all") - F.col("lead.idf") * F.col("lead.most")
        driven = lead.select("query_id", "lead.term", "lead.idf", rest.alias("rest"))
        met = lookup_join(self.heads, driven, ["term"], "inner", ["segment", "block"])
        limit = F.round(F.col("idf") * F.col("limit") + F.col("rest") + 1e-9, places)
        self.blocks = materialize(met.select("query_id", "term", "segment", "block", "span", "docs", limit.alias("limit")), "query-blocks")

    def _scores(self, blocks: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents in these blocks that have all words of the query. Of other words only the
        blocks around these documents are opened."""
        postings = self.index.postings(self.asked.select("term").distinct()).select("term", "segment", "block", "offsets", "counts", "lengths")
        drive = blocks.select("query_id", "term", "segment", "block", "span").join(postings.select("term", "segment", "block", "offsets"), ["term", "segment", "block"])
        first = (F.col("block") * F.col("span")).alias("first")
        found = drive.select("query_id", "segment", first, F.explode("offsets").alias("offset"))
        found = found.select("query_id", "segment", (F.col("first") + F.col("offset")).alias("doc_id"))
        wide = self.heads.select("term", "segment", "span").distinct()
        looked = lookup_join(found, self.asked.select("query_id", "term", "idf", "wanted"), ["query_id"], "inner", ["doc_id"])
        looked = lookup_join(looked, wide, ["term", "segment"], "inner", ["doc_id"])
        looked = looked.withColumn("block", F.floor(F.col("doc_id") / F.col("span")).cast("long"))
        # The block of a word meets all documents asked of it at once.
        ask = F.struct("query_id", "doc_id", "idf", "wanted", (F.col("doc_id") - F.col("block") * F.col("span")).alias("offset"))
        met = looked.withColumn("ask", ask).select("term", "segment", "block", "ask").join(postings, ["term", "segment", "block"])
        at = F.array_position("offsets", F.col("ask.offset")).cast("int")
        part = bm25_part(F.element_at("counts", at), F.element_at("lengths", at), F.col("ask.idf"), self.mean_length, self.k1, self.b)
        parts = met.where(F.array_contains("offsets", F.col("ask.offset"))).select("ask.query_id", "ask.doc_id", "ask.wanted", part.alias("part"))
        summed = parts.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("got"), F.max("wanted").alias("wanted"), F.sum("part").alias("score"))
        hits = summed.where("got = wanted").select("query_id", "doc_id", F.round(F.round("score", SCORE_PLACES), self.places).alias("score"))
        return self._with_phrases(hits)

    def _with_phrases(self, hits: DataFrame) -> DataFrame:
        """The hits whose documents hold the query's phrases."""
        if not self.phrases.head(1):
            return hits
        if self.holding is None:
            needs = self.phrases.select("unit", F.lit(True).alias("phrase")).distinct()
            self.holding = materialize(index_unit_counts(self.index, needs).select("doc_id", "unit"), "phrase-documents")
        wanted = self.phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
        asked = lookup_join(hits.join(wanted, "query_id"), self.phrases, ["query_id"], "inner", ["doc_id"])
        good = asked.join(self.holding, ["doc_id", "unit"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("got"), F.max("wanted").alias("wanted"))
        plain = hits.join(wanted, "query_id", "left_anti")
        return plain.unionByName(hits.join(good.where("got = wanted").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"))

    def hits(self) -> DataFrame:
        """(query_id, doc_id, score, rank), rank from 1 to k: the head of the full ranking."""
        order = [F.col("score").desc(), F.col("doc_id")]
        probe = top_k(self.blocks, ["query_id"], [F.col("limit").desc(), F.col("segment"), F.col("block")], self.k, ["block"]).drop("rank")
        probe = materialize(probe, "first-blocks")
        first = materialize(self._scores(probe), "first-hits")
        limits = top_k(first, ["query_id"], order, self.k, ["doc_id"]).where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        more = self.blocks.join(probe.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti")
        more = lookup_join(more, limits, ["query_id"], "left", ["block"]).where("least IS NULL OR limit >= least").drop("least")
        more = materialize(more, "more-blocks")
        self.opened = probe.unionByName(more)
        return top_k(first.unionByName(self._scores(more)), ["query_id"], order, self.k, ["doc_id"])


def page_index(index: SearchIndex, queries: DataFrame, pageno: int = 1, page_size: int = 20, places: int = SCORE_PLACES) -> DataFrame:
    """A page of each query's hits; `rank` counts within the page."""
    before = page_size * (max(pageno, 1) - 1)
    found = TopHits(index, queries, before + page_size, places).hits()
    return found.where(F.col("rank") > before).withColumn("rank", (F.col("rank") - before).cast("int"))
