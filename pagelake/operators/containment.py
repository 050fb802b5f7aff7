"""Which texts hold which patterns as substrings, for many of both, without comparing every pair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.plans.reuse import materialize
from pagelake.plans.skew import skew_join

GRAM = 3
# Patterns of one automaton take about as many characters; more patterns are worked through in further passes.
AUTOMATON_CHARS = 4_000_000


def grams(text: Column, size: Column | int) -> Column:
    """The distinct substrings of `size` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, size)))


def contained(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """The distinct (keys, text, pattern) where the text holds the pattern and the keys are equal.

    For short texts (anchors, names). A pattern of at least GRAM characters meets texts at its rarest gram only and is then
    looked for; a shorter one is equal to a gram of its own size; an empty one is in every text
    of its keys that is not null. Null texts and patterns meet nothing.
    """
    texts = texts.where(F.col(text).isNotNull()).select(*keys, text).distinct()
    patterns = materialize(patterns.where(F.col(pattern).isNotNull()).select(*keys, pattern).distinct(), "patterns")
    sizes = F.array(*[F.lit(n) for n in range(GRAM + 1)])
    held = texts.select(*keys, text, F.explode(F.flatten(F.transform(sizes, lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(grams(F.col(text), n))))).alias("gram"))
    long = patterns.where(F.length(pattern) >= GRAM).select(*keys, pattern, F.explode(grams(F.col(pattern), GRAM)).alias("gram"))
    # Only grams of some pattern are counted.
    counts = held.join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
    placed = long.join(counts, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = placed.groupBy(*keys, pattern).agg(F.min(F.struct("count", "gram")).alias("least"))
    anchors = rarest.where("least.count > 0").select(*keys, pattern, "least.gram")
    anchors = materialize(anchors.unionByName(patterns.where(F.length(pattern) < GRAM).withColumn("gram", F.col(pattern))), "pattern-grams")
    met = skew_join(held, anchors, [*keys, "gram"], "inner", [text])
    return met.where(F.contains(text, pattern)).select(*keys, text, pattern).distinct()


def found_in_texts(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct (id, pattern) of patterns (pattern) that stand somewhere in the texts.

    For long texts: each text is read once by an automaton of all patterns (Aho-Corasick), however many there are.
    Patterns beyond AUTOMATON_CHARS go to further automata, each of which reads the texts again. Empty patterns are in every text that is not null.
    """
    patterns = materialize(patterns.where(F.col("pattern").isNotNull()).select("pattern").distinct(), "patterns")
    characters = patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0
    parts = characters // AUTOMATON_CHARS + 1
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("pattern", T.StringType())])
    narrow = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias(text_col))
    everywhere = bool(patterns.where("pattern = ''").head(1))
    found = narrow.where(F.lit(everywhere)).select(id_col, F.lit("").alias("pattern"))
    for part in range(parts):
        # One automaton's share of the patterns is of a fixed size.
        share = patterns.where((F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part) & (F.col("pattern") != ""))
        words = [row["pattern"] for row in share.collect()]
        if words:
            found = found.unionByName(narrow.mapInArrow(_finder(words, id_col), schema))
    return found


def _finder(words: list[str], id_col: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for k, text in enumerate(batch.column(1)):
                here = {word for _, word in automaton.iter(text.as_py())}
                rows += [k] * len(here)
                hits += here
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=[id_col, "pattern"])

    return find
