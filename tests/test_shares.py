"""Joins by keys that hold a third of the rows: the plain join's rows, no part with most of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import align as A
from readloom.operators import counting as C
from readloom.operators.shares import in_shares


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_join_in_shares(spark):
    many = spark.range(30_000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("long").alias("k"), F.lit("a").alias("c"))
    few = spark.createDataFrame([("a", k, n) for k in range(0, 5000, 7) for n in range(2)], "c string, k long, n int")
    dealt, repeated = in_shares(many, few, ["c", "k"], ["i"])
    met = dealt.join(repeated, ["c", "k", "__part"])
    assert rows_of(met.select("i", "c", "k", "n")) == rows_of(many.join(few, ["c", "k"]).select("i", "c", "k", "n"))
    largest = dealt.groupBy("c", "k", "__part").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 30  # a thousandth of the rows is 30
    assert repeated.count() < few.count() + 2 * 2000
    outer = dealt.join(repeated, ["c", "k", "__part"], "left")
    assert rows_of(outer.select("i", "k", "n")) == rows_of(many.join(few, ["c", "k"], "left").select("i", "k", "n"))


@pytest.mark.parametrize("empty", ["many", "few"])
def test_no_rows(spark, empty):
    many, few = (spark.createDataFrame([] if empty == n else [(1, "x")], "k int, v string") for n in ("many", "few"))
    dealt, repeated = in_shares(many, few, ["k"], ["v"])
    assert dealt.join(repeated, ["k", "__part"]).count() == 0


def test_counts_at_a_hot_locus(spark, monkeypatch):
    """Features beyond what may be broadcast: a third of the reads lie in one bin."""
    rng = random.Random(1)
    places = [100] * 600 + [rng.randrange(1, 400_000) for _ in range(1200)]
    reads = spark.createDataFrame([(f"r{i}", 16 * (i % 2), rng.choice(["c1", "c1", "c2"]) if p != 100 else "c1", p, 40, "60M" if i % 5 else "20M3000N40M", 0, 1) for i, p in enumerate(places)], "fid string, flag int, chr string, pos int, mapq int, cigar string, tlen int, nh int")
    features = spark.createDataFrame([(f"f{i}{c}", f"g{i % 90}", c, 1 + i * 700, i * 700 + 500, "+-"[i % 2]) for i in range(500) for c in ("c1", "c2")] + [("f_hot", "g_hot", "c1", 120, 140, "+"), ("f_wide", "wide", "c1", 90, 300_000, "-")], "feature_id string, gene_id string, chr string, start int, end int, strand string")
    for o in (C.CountOptions(strand=1), C.CountOptions(allow_multi_overlap=True, fraction=True)):
        run = lambda: rows_of(C.assign(C.single_fragments(reads), features, o))
        want = run()
        with monkeypatch.context() as m:
            m.setattr(C, "BROADCAST_FEATURES", 0)
            assert run() == want


def test_reads_at_a_hot_locus(spark):
    rng = random.Random(2)
    g = "".join(rng.choice("ACGT") for _ in range(9000))
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, 9000, 1000)], "chr string, start long, seq string")
    at = [2500] * 200 + [rng.randrange(0, 8900) for _ in range(300)]
    reads = spark.createDataFrame([(f"r{i}", g[a : a + 80], "I" * 80) for i, a in enumerate(at)], "rid string, seq string, qual string")
    got = {r["rid"]: (r["chr"], r["pos"], r["cigar"]) for r in A.align(reads, A.build_index(chunks, chunk=1000), chunks, A.AlignOptions(), 1000).collect()}
    assert got == {f"r{i}": ("c1", a + 1, "80M") for i, a in enumerate(at)}
