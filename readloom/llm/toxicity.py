"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space is made single spaces, and the n-grams of its characters are hashed to 2**LOG2
features that are present or absent in the whole text.  A sample of labelled documents gives each feature's
log-count ratio: the log of its share of toxic documents over its share of others.  The features that tell the classes
apart most surely, at most ``features``, are multiplied by their ratios, and logistic regression weighs them.

Bounds: ``per_class`` documents of each class, ``features`` features.  Null text is empty text: the model's intercept
scores it.  Where a class has no labels, all scores are the share of toxic ones.  Repeated rows are scored each; a null id is scored
and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import text_of
from readloom.llm.labels import held_out, labelled_sample, sigmoid

ORDERS = (3, 4, 5, 6)
LOG2 = 20
PER_CLASS = 6000
FEATURES = 8192
#: Features whose log-count ratio is nearer to 0, or whose classes differ by fewer standard errors, are left out.
LEAST_RATIO, LEAST_Z = 1.5, 3.0
RIDGE, STEPS, RATE = 1.0, 300, 0.1
THRESHOLD = 0.5
#: n-grams are hashed so many characters at a time.
WINDOW = 1 << 20
SEGMENT_LOG2 = 16


def gram_windows(text: str) -> Iterator[np.ndarray]:
    """The features of all n-grams of a text, repeats included, an order and a window at a time."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32)
    most = max(ORDERS)
    for a in range(0, len(data), WINDOW):
        b = data[a : a + WINDOW + most - 1]
        h = b
        for n in range(2, most + 1):
            if len(b) < n:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :]
            if n in ORDERS:
                m = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
                yield (m ^ (m >> np.uint32(13))) >> np.uint32(32 - LOG2)


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The features in a text, each once; only those where wanted is true."""
    found = [g if wanted is None else g[wanted[g]] for g in gram_windows(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of class 0 and 1 have each feature, a row a segment of features."""
    counts = np.zeros((2, 1 << LOG2), np.int32)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[label][present(text.as_py())] += 1
    size = 1 << SEGMENT_LOG2
    if counts.any():
        n = 1 << (LOG2 - SEGMENT_LOG2)
        yield pa.record_batch([pa.array(range(n), pa.int32()), *(pa.array([c[i * size : (i + 1) * size].tobytes() for i in range(n)]) for c in counts)], ["segment", "zero", "one"])


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = [sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group[c]).astype(np.int32).tobytes() for c in ("zero", "one")]
    return pd.DataFrame({"segment": [group["segment"].iloc[0]], "zero": [total[0]], "one": [total[1]]})


def log_count_ratios(zero: np.ndarray, one: np.ndarray, n_zero: int, n_one: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios, and by how many standard errors the classes' shares differ."""
    ratio = np.log((one + 1) / (n_one + 2)) - np.log((zero + 1) / (n_zero + 2))
    a, b = one / n_one, zero / n_zero
    return ratio, np.abs(a - b) / np.sqrt((a * (1 - a) + 1 / n_one) / n_one + (b * (1 - b) + 1 / n_zero) / n_zero)


def regress(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features times their ratios, and the intercept."""
    at, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    value, total = ratio[col], weight.sum()
    w, b = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1):
        error = weight * (sigmoid(np.bincount(at, value * w[col], len(rows)) + b) - y)
        slope = np.r_[np.bincount(col, value * error[at], len(ratio)) + RIDGE * w, error.sum()] / total
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w * ratio, b


class ToxicityModel:
    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.weight = np.zeros(1 << LOG2, np.float32)
        self.weight[features] = weights
        self.wanted, self.intercept = self.weight != 0, intercept

    def score(self, text: str) -> float:
        return float(sigmoid(np.float64(self.weight[present(text, self.wanted)].sum(dtype=np.float64) + self.intercept)))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, features: int) -> ToxicityModel:
    sample, (n_zero, n_one) = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    kept = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(0, np.int64)
    if not (kept.get(0) and kept.get(1)):
        return ToxicityModel(none, np.zeros(0), float(np.log((n_one + 1) / (n_zero + 1))))
    counts = sample.select("label", "text").mapInArrow(_count_batches, "segment int, zero binary, one binary")
    counts = counts.groupBy("segment").applyInPandas(_add, "segment int, zero binary, one binary").toPandas().sort_values("segment")
    zero, one = (np.concatenate([np.frombuffer(x, np.int32) for x in counts[c]]) for c in ("zero", "one"))
    ratio, z = log_count_ratios(zero, one, kept[0], kept[1])
    z = np.where((np.abs(ratio) >= LEAST_RATIO) & (z >= LEAST_Z), z, 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[: min(features, int((z > 0).sum()))])
    place = np.full(1 << LOG2, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = place >= 0
        for batch in batches:
            found = [place[present(t.as_py(), wanted)].astype("<u2").tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["label", "found"])

    rows = sample.select("label", "text", "o", "id").orderBy("o", "id").select("label", "text").mapInArrow(rows_of, "label int, found binary").toPandas()
    y = rows["label"].to_numpy()
    weight = np.where(y == 1, n_one / kept[1], n_zero / kept[0]) * len(y) / (n_one + n_zero)
    weights, intercept = regress([np.frombuffer(x, "<u2").astype(np.int64) for x in rows["found"]], y, ratio[chosen], weight)
    return ToxicityModel(chosen, weights, intercept)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, features: int = FEATURES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: <id_col>, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, id_col, text_col, label_col, per_class, features))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).withColumnRenamed("id", id_col)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, features: int = FEATURES, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, id_col, text_col, label_col, per_class, features))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score)

    return docs.filter(score(text_of(text_col)) < threshold)
