"""Quality by compression.

Two Zstandard dictionaries are trained on pieces of good and of bad labelled texts.  A text is cut into chunks small enough for
the dictionary to matter all along it, and each is compressed with both.  Its normalised difference is the size with the good
dictionary less that with the bad one, over the larger.  A text's measures are the difference of the two sums over the whole
text, and of its chunks' differences the mean, spread, mean magnitude, median, and the shares above zero and at zero, for each of
the chunk sizes CHUNKS; they go, with their squares, through a logistic calibration that other labelled documents give, weighted to the classes' shares.  Neither length nor
compression ratio is an input.

Bounds: ``dictionary_docs`` and ``calibration_docs`` documents of each class, and PIECE bytes of a document for a
dictionary.  Null text is empty text and gets a score like any other.  Where a class has no labels, all scores
are the share of good ones.  Repeated rows are scored each; a null id is scored and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import text_of
from readloom.llm.labels import held_out, labelled_sample, sigmoid
from readloom.llm.warc import train

DICTIONARY_DOCS = 1500
CALIBRATION_DOCS = 3000
PIECE = 8192
CHUNKS = (128, 512)
#: Differences of a chunk size.
MEASURES = 7
LEVEL = 3
DICTIONARY_BYTES = 112_640
THRESHOLD = 0.3


def _codec(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)


def compressed_sizes(text: bytes, chunk: int, codecs: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    """Sizes of a text's chunks with the first and, in the second row, with the second codec; an empty text is one chunk."""
    chunks = [text[a : a + chunk] for a in range(0, max(len(text), 1), chunk)]
    return np.array([[len(c.compress(x)) for x in chunks] for c in codecs], float)


def differences(sizes: np.ndarray) -> list[float]:
    """Of the sums, and of the chunks' mean, spread, mean magnitude, median, and shares above and at zero."""
    good, bad = sizes
    each = (good - bad) / np.maximum(good, bad)
    return [(good.sum() - bad.sum()) / max(good.sum(), bad.sum()), each.mean(), each.std(), np.abs(each).mean(), np.median(each), (each > 0).mean(), (each == 0).mean()]


def measures(texts: list[bytes], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """A row a text."""
    codecs = tuple(map(_codec, dictionaries))
    x = np.array([[v for c in CHUNKS for v in differences(compressed_sizes(t, c, codecs))] for t in texts]).reshape(len(texts), MEASURES * len(CHUNKS))
    return np.c_[x, x * x]


class Calibration:
    """Logistic regression by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ self.w)
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(self.w)) * ridge
            self.w = self.w + np.linalg.solve(curve, z.T @ (weight * (y - p)) - ridge * self.w)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(x) @ self.w)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    dictionary_docs: int = DICTIONARY_DOCS, calibration_docs: int = CALIBRATION_DOCS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: <id_col>, held_out, score, predicted."""
    spark = docs.sparkSession
    sample, (n_bad, n_good) = labelled_sample(docs, labels, label_col, dictionary_docs + calibration_docs, id_col, text_col)
    share = dictionary_docs / (dictionary_docs + calibration_docs)
    sample = sample.withColumn("for_dictionary", F.pmod(F.xxhash64(F.lit("dictionary"), "id"), F.lit(1000)) < int(1000 * share))
    at = F.pmod(F.col("o"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1
    pieces = sample.filter("for_dictionary").select("label", "o", F.substring("text", at, F.lit(PIECE)).alias("piece")).orderBy("o").collect()
    dictionaries = tuple(train([r["piece"].encode()[:PIECE] for r in pieces if r["label"] == y], DICTIONARY_BYTES) for y in (1, 0))

    names = [f"m{i}" for i in range(2 * MEASURES * len(CHUNKS))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(_texts(batch), dictionaries)
            yield pa.record_batch([batch.column(0), *map(pa.array, m.T)], ["label", *names])

    rows = sample.filter("not for_dictionary").select("label", "text").mapInArrow(measured, "label int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    y = rows["label"].to_numpy()
    model = None
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, n_good / y.sum(), n_bad / (len(y) - y.sum())) * len(y) / (n_good + n_bad)
        model = Calibration(rows[names].to_numpy(), y, weight)
    prior = (n_good + 1) / (n_good + n_bad + 2)
    shared = spark.sparkContext.broadcast((dictionaries, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, model = shared.value
        for batch in batches:
            s = model(measures(_texts(batch), dictionaries)) if model else np.full(batch.num_rows, prior)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s)], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).withColumnRenamed("id", id_col)
