"""Labelled training samples of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import id_fold, materialise, sampled, text_of

#: Rows whose crc32(id) modulo FOLDS is 0 are held out: their labels are never read.
FOLDS = 5


def held_out(id_col: str):
    return F.coalesce(id_fold(id_col, FOLDS) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple[int, int]]:
    """At most per_class documents of each class, first by a hash of their id: id, text, label, and o, that hash.  And how
    many ids of class 0 and 1 there are to learn from.

    Held-out ids, null ids and null labels are left out, and so are ids with both labels; a repeated label counts once, and
    of repeated documents one is taken.  The list of chosen ids, at most 2 * per_class, is broadcast.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out("id"))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top").drop("top")
    known = known.withColumn("o", F.xxhash64(F.lit(label_col), "id"))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.filter((F.col("label") == y) & sampled(F.col("o"), per_class, count.get(y, 0))).orderBy("o", "id").limit(per_class) for y in (0, 1)]
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")
    return materialise(sample.dropDuplicates(["id"]), "sample"), (count.get(0, 0), count.get(1, 0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
