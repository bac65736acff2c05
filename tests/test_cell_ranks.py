"""Cell calls have no rank cap and equal the resampling that they stand for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from readloom.operators import singlecell as S


def resampled(totals, stride):
    n, at, found = len(totals), len(totals) // 2, []
    for _ in range(5):
        some = []
        for _ in range(n):
            at %= n
            some.append(totals[at])
            at += stride
        some.sort(reverse=True)
        limit = int(some[min(29, n - 1)] / 10 + 0.5)
        found.append(sum(x >= limit for x in some))
    return int(np.mean(found) + 0.5)


def test_count_equals_resampling():
    rng = np.random.default_rng(1)
    for n in [1, 2, 29, 30, 31, 64, 210, 999]:
        for stride in [11_218_439, 7, 6, 30, n]:
            totals = np.sort(rng.integers(1, 4000, n) // rng.integers(1, 300, n) + 1)[::-1]
            each, cells = np.unique(totals, return_counts=True)
            want = resampled(totals.tolist(), stride)
            assert S.high_confidence_count(totals, stride=stride) == S.high_confidence_count(each[::-1], cells[::-1], stride) == want, (n, stride)


def test_more_than_100000_cells(spark):
    counts = spark.range(100_500).select(F.lit(1).alias("sample"), F.col("id").alias("cell"), F.lit("g").alias("gene"), (F.col("id") % 20 + 40).alias("umis"))
    assert S.call_cells(counts).filter("high").count() == 100_500
