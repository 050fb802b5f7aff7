"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.plans.reuse import materialize

# Documents are wide rows: a batch between Spark and Python holds so many at most.
ROWS_PER_BATCH = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A window task ranks about as many rows.
ROWS_PER_SLICE = 250_000
# A list of ids up to this many rows (8 bytes each and overhead) may be broadcast.
BROADCAST_IDS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches hold ROWS_PER_BATCH rows at most; smaller settings stay."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= ROWS_PER_BATCH:
        spark.conf.set(BATCH_SETTING, ROWS_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the session set for wide rows."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str = "narrow", row: str = "row") -> DataFrame:
    """The rows written once with a unique number each. Every later step reads the written
    number, so a retried or re-planned scan can't deal other numbers."""
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name)


def gapless_rank(df: DataFrame, group: str, row: str = "row", rank: str = "rank") -> tuple[DataFrame, dict[int, int]]:
    """Rank 0, 1, 2 ... without gaps inside each group, and the groups' sizes.

    `group` has few values (a bounded domain: arcs of a ring, lengths up to a limit), but
    one may own most rows. So each group is cut into slices of about ROWS_PER_SLICE rows by a
    hash of the unique row number; a task ranks one slice, and slices get offsets.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    slices = df.sparkSession.createDataFrame(
        [(g, max(1, -(-n // ROWS_PER_SLICE))) for g, n in sizes.items()], f"{group} {df.schema[group].dataType.simpleString()}, _slices long"
    )
    cut = df.join(F.broadcast(slices), group).withColumn("_slice", F.pmod(F.xxhash64(row), F.col("_slices"))).drop("_slices")
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(group, "_slice").count().select(group, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(row)) - 1
    ranked = cut.withColumn("_inside", inside).join(offsets, [group, "_slice"])
    return ranked.withColumn(rank, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before"), sizes


def keep_rows(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join of whole rows with a list of distinct ids, null-safe. The list is
    broadcast when its counted size allows; else both sides are shuffled."""
    listed = fresh(docs, "_listed")
    ids = ids.select(F.col(key).alias(listed))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs[key].eqNullSafe(F.col(listed)), how)


def keep_judged(docs: DataFrame, judged: DataFrame, fingerprint: Column, judged_print: str, id_col: str) -> DataFrame:
    """The rows of `docs` that `judged` (doc_id, kept and a fingerprint of the text) keeps, with all columns.

    Rows leave by doc_id. Ids that have both kept and dropped rows (repeated rows) are set
    apart and settled by fingerprint, one row for each kept one.
    """
    per_id = judged.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go"))
    out = materialize(per_id.where("go > 0"), "judged-ids").withColumnRenamed("doc_id", id_col)
    rest = keep_rows(docs, out, "left_anti", id_col)
    mixed = out.where("stay > 0").select(id_col)
    if not mixed.head(1):
        return rest
    own, key, theirs = (fresh(docs, name) for name in ("_print", "_id", "_kept_print"))
    again = keep_rows(docs, mixed, "left_semi", id_col).withColumn(own, fingerprint).dropDuplicates([id_col, own])
    wanted = judged.where("kept").select(F.col("doc_id").alias(key), F.col(judged_print).alias(theirs))
    settled = again.join(wanted, again[id_col].eqNullSafe(F.col(key)) & (F.col(own) == F.col(theirs)), "left_semi")
    return rest.unionByName(settled.drop(own))
