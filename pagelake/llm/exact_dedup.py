"""Exact dedup: a tree-merge of sorted digest runs.

Every input partition is one run: its rows' digests, sorted. The runs meet in binomial
rounds with a fan-in of FAN_IN: run r goes to node r // FAN_IN, that node to its own
parent, and so on to the root. At each node the incoming runs are sorted together and
entries of equal digest and equal proof (SHA-256 and length of the whole normalised
text) become one entry, which keeps the identifier of the row that stays and the count.

The digest space is cut into segments, each with a tree of its own, so the root's work
is spread as well. A hot text costs a node at most one entry per child, whatever its
number of copies; only the lowest level sees single rows, and there one node has the
rows of FAN_IN partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import LOWER, UPPER, keep_judged, lower_ascii, numbered, partitions
from pagelake.plans.reuse import materialize

FAN_IN = 8
ROWS_PER_SEGMENT = 1_000_000
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, digests, sizes = [], [], []
        for text in batch.column(1):
            raw = (text.as_buffer() or b"") if text.is_valid else b""
            normal = bytes(raw).translate(LOWER_BYTES)
            proof = hashlib.sha256(normal).digest()
            proofs.append(proof)
            digests.append(int.from_bytes(proof[:8], "little", signed=True))
            sizes.append(len(normal))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.int64()), pa.array(proofs, pa.binary()), pa.array(sizes, pa.int64())],
            names=["doc_id", "digest", "proof", "size"],
        )


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One sorted run per partition: (doc_id, digest, proof, size, row, run). Null text is empty.

    Only the two columns are read; the text ends here.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    digests = pairs.mapInArrow(_digest_batches, "doc_id long, digest long, proof binary, size long")
    return numbered(digests.withColumn("run", F.spark_partition_id()).sortWithinPartitions("digest", "proof"), "digest-runs")


def merge_runs(runs: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One verified entry per distinct text: (digest, proof, size, keep_id, keep_row, group_size).

    `keep` is `smallest` or `largest` doc_id; equal identifiers (repeated rows) go by row
    number, null identifiers come last.
    """
    spark = runs.sparkSession
    count, last = runs.agg(F.count(F.lit(1)), F.coalesce(F.max("run"), F.lit(0))).first()
    width = partitions(spark)
    segments = max(4 * width, -(-count // ROWS_PER_SEGMENT))
    # The entry that stays is the greatest (has id, order, -row): null ids lose.
    order = F.col("doc_id") if keep == "largest" else -F.col("doc_id")
    level = runs.select(
        F.pmod("digest", F.lit(segments)).alias("segment"),
        F.col("run").alias("node"),
        "digest",
        "proof",
        "size",
        F.struct(F.col("doc_id").isNotNull().alias("known"), order.alias("order"), (-F.col("row")).alias("first")).alias("best"),
        F.lit(1).cast("long").alias("group_size"),
    )
    nodes = last + 1
    while True:
        nodes = -(-nodes // fan_in)
        met = level.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).repartition(width, "segment", "node")
        met = met.sortWithinPartitions("segment", "node", "digest", "proof")
        merged = met.groupBy("segment", "node", "digest", "proof", "size")
        level = merged.agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
        if nodes == 1:
            break
    kept = F.col("best.order") if keep == "largest" else -F.col("best.order")
    return level.select("digest", "proof", "size", kept.alias("keep_id"), (-F.col("best.first")).alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null and empty texts are one
    group. Of repeated identical rows exactly one is kept. A null doc_id is kept only if the
    whole group has none. An empty table gives no rows; other columns are not looked at.
    """
    runs = digest_runs(docs, id_col, text_col)
    classes = materialize(merge_runs(runs, keep), "digest-classes").drop("size")
    return runs.join(classes, ["digest", "proof"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("proof")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts; all columns stay."""
    judged = materialize(exact_dedup(docs, keep, id_col, text_col), "dedup-judged")
    sha = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    return keep_judged(docs, judged, sha, "text_sha256", id_col)
