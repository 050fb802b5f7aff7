"""Toxicity as ordinal regression: a cumulative-link model over sparse text features.

Severity grades 0 (clean) to 3 are ordered. The model gives P(grade > k) = sigmoid(w.x - t_k):
one weight vector shared by all thresholds t_1 < t_2 < t_3. Features are words and
word beginnings of three to seven letters, with 1 + log(count) as value; they are chosen by
their z-score between toxic and clean rows. Labels say toxic or not; the grades of toxic
rows are thirds by how many words they have that are seldom clean.

The model is fitted on at most MOST_LABELLED labelled rows, a hash sample of all of them.
Everything else covers all rows: scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import fresh
from pagelake.plans.reuse import materialize

MOST_LABELLED = 8_000
MOST_FEATURES = 6_000
LEAST_ROWS = 3
GRADES = 4
# Chosen on held-out rows: clean rows stay below it, rows with few toxic words reach it.
TOXIC_FROM = 0.3
BEGINNINGS = (3, 4, 5, 6, 7)
WORD = re.compile(r"\w+")
CHUNKS_KEPT = 150_000
SCORE = "struct<expected_severity double, p_toxic double, grade int>"


def chunk_features(chunk: str) -> list[str]:
    """The features of a lower-case run of non-spaces: its words, and `beginning*` marks."""
    found = []
    for word in WORD.findall(chunk):
        found.append(word)
        found.extend(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)
    return found


def text_features(text: str) -> Counter:
    counts: Counter = Counter()
    for chunk, n in Counter(text.lower().split()).items():
        for feature in chunk_features(chunk):
            counts[feature] += n
    return counts


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """At most `most` labelled documents (doc_id, text, toxic), by hash order of their id.

    Null ids and labels are left out, a doc_id with several labels has the highest, a
    repeated document counts once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([list(r) for r in rows], pa.list_(pa.string())),
                pa.array([list(r.values()) for r in rows], pa.list_(pa.int32())),
            ],
            names=["doc_id", "toxic", "features", "counts"],
        )


class Model:
    """Feature weights, thresholds; small enough to travel with each task."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "known": {}}

    def link(self, text: str | None) -> float:
        """w.x of a whole text; null counts as empty."""
        counts: dict[str, int] = {}
        for chunk, n in Counter((text or "").lower().split()).items():
            used = self.known.get(chunk)
            if used is None:
                if len(self.known) >= CHUNKS_KEPT:
                    self.known.clear()
                used = self.known[chunk] = tuple(f for f in chunk_features(chunk) if f in self.weights)
            for feature in used:
                counts[feature] = counts.get(feature, 0) + n
        return math.fsum(self.weights[f] * (1 + math.log(n)) for f, n in counts.items())

    def scores(self, links: np.ndarray) -> pd.DataFrame:
        above = 1 / (1 + np.exp(-np.clip(links[:, None] - self.thresholds[None, :], -50, 50)))  # P(grade > k)
        grade = (above >= 0.5).sum(1)
        return pd.DataFrame({"expected_severity": above.sum(1).round(6), "p_toxic": above[:, 0].round(6), "grade": grade.astype("int32")})


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, rounds: int = 300, ridge: float = 1e-4):
    """Weights and thresholds of the cumulative-link model by full-batch AdaGrad on the mean log-loss."""
    weights, seen = np.zeros(width), np.full(width, 1e-8)
    share = np.array([(grade > k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(GRADES - 1))
    seen_t = np.full(GRADES - 1, 1e-8)
    n = len(grade)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for _ in range(rounds):
        links = np.bincount(row, value * weights[column], n)
        above = np.column_stack([np.ones(n), sigmoid(links[:, None] - thresholds), np.zeros(n)])
        p = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)  # d above / d link
        g_link = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p / n
        g_t = np.zeros(GRADES + 1)
        np.add.at(g_t, grade, slope[np.arange(n), grade] / p / n)
        np.add.at(g_t, grade + 1, -slope[np.arange(n), grade + 1] / p / n)
        g_w = np.bincount(column, value * g_link[row], width) + ridge * weights
        seen += g_w**2
        seen_t += g_t[1:-1] ** 2
        weights -= 0.1 * g_w / np.sqrt(seen)
        thresholds = np.maximum.accumulate(thresholds - 0.05 * g_t[1:-1] / np.sqrt(seen_t) + 1e-6 * np.arange(GRADES - 1))
    return weights, thresholds


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_features: int = MOST_FEATURES) -> Model:
    """The model fitted on the labelled rows. Without both toxic and clean ones nothing is toxic."""
    sample = labelled_rows(docs, labels, most)
    clean, toxic = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") > 0)).first()
    if not clean or not toxic:
        return Model({}, np.array([20.0, 21.0, 22.0]))
    counted = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        _features, "doc_id long, toxic int, features array<string>, counts array<int>"
    )
    counted = materialize(counted, "labelled-features")
    bad, good = F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    per = counted.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(bad, good)
    both = (F.col("bad") + F.col("good")) / (clean + toxic)
    z = (F.col("bad") / toxic - F.col("good") / clean) / F.sqrt(both * (1 - both + 1e-9) * (1 / toxic + 1 / clean))
    best = per.where(F.col("bad") + F.col("good") >= LEAST_ROWS).withColumn("z", z)
    best = best.orderBy(F.abs("z").desc(), "feature").limit(most_features).collect()
    index = {r["feature"]: k for k, r in enumerate(best)}
    telling = {k for k, r in enumerate(best) if r["bad"] >= 9 * r["good"]}
    chosen = F.broadcast(sample.sparkSession.createDataFrame(list(index.items()), "feature string, at int")) if index else None
    if chosen is None:
        return Model({}, np.array([20.0, 21.0, 22.0]))
    pairs = counted.select("doc_id", "toxic", F.explode(F.arrays_zip("features", "counts")).alias("x"))
    pairs = pairs.select("doc_id", "toxic", F.col("x.features").alias("feature"), F.col("x.counts").alias("n")).join(chosen, "feature")
    lists = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("used"))  # at most most_features
    rows = counted.select("doc_id", "toxic").join(lists, "doc_id", "left").orderBy("doc_id")
    rows = rows.select("toxic", F.coalesce("used.at", F.array()).alias("at"), F.coalesce("used.n", F.array()).alias("n")).toArrow()
    toxic_rows = rows["toxic"].to_numpy() > 0
    row = np.repeat(np.arange(len(toxic_rows)), pc.list_value_length(rows["at"]).to_numpy())
    column, times = (pc.list_flatten(rows[name]).to_numpy().astype(np.int64) for name in ("at", "n"))
    # Grades of toxic rows: thirds by how many telling words they have.
    strength = np.bincount(row, times * np.isin(column, list(telling)), len(toxic_rows))
    grade = np.zeros(len(toxic_rows), np.int64)
    grade[toxic_rows] = 1 + np.searchsorted(np.quantile(strength[toxic_rows], [1 / 3, 2 / 3]), strength[toxic_rows], side="left")
    value = 1 + np.log(times)
    weights, thresholds = fit_ordinal(row, column, value, grade, len(index))
    return Model({f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 1e-6}, thresholds)


def with_severity(docs: DataFrame, model: Model, text_col: str = "text", name: str = "severity") -> DataFrame:
    """All columns and a struct (expected_severity, p_toxic, grade)."""

    @F.pandas_udf(SCORE)
    def severity(texts: pd.Series) -> pd.DataFrame:
        return model.scores(np.array([model.link(t) for t in texts]))

    return docs.withColumn(name, severity(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """One row per document: doc_id, expected_severity (0 to 3), p_toxic, grade, toxic.

    Null and empty texts have no features and so the base rate. Repeated rows score alike.
    """
    scored = with_severity(docs.select("doc_id", "text"), fit(docs, labels), name="s")
    return scored.select("doc_id", "s.expected_severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= toxic_from).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    name = fresh(docs, "_severity")
    scored = with_severity(docs, fit(docs, labels), name=name)
    return scored.where(F.col(f"{name}.p_toxic") < toxic_from).drop(name)
