"""Keys that hold a third of all rows: the same results as plain windows, in shares."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.operators import align as A
from readloom.operators import events as E
from readloom.operators import intervals as I
from readloom.operators import readtools as R
from readloom.operators import singlecell as S


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_index_of_a_repeat(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    unit = "".join(rng.choice("ACGT") for _ in range(20))
    g = base[:1000] + "A" * 1500 + unit * 5 + base[1000:] + unit * 3
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, len(g), 1000)], "chr string, start long, seq string")
    places = {}
    for i in range(len(g) - 15):
        places.setdefault(int(g[i : i + 16].translate(str.maketrans("ACGT", "0123"))), []).append(i + 1)
    for most in (1, 4, 8, 2000):
        want = sorted((k, "c1", p) for k, ps in places.items() if len(ps) <= most for p in ps)
        assert rows_of(A.build_index(chunks, 1, most, 1000).select("kmer", "chr", "pos")) == sorted(want, key=repr)
    few = spark.createDataFrame([("c1", 1, g[900:2600], 1)], "chr string, start long, seq string, last long")
    sent = few.mapInArrow(A._places(1, 65_536, 100), "chr string, pos long, kmer long")
    assert sent.filter("kmer = 0").count() == 101  # of about 1,485


def test_ranks_of_equal_totals(spark):
    rng = random.Random(2)
    for kind, name in (("int", lambda c: c), ("string", lambda c: "".join("ACGT"[c >> 2 * i & 3] for i in range(8)))):
        counts = spark.createDataFrame([(rng.randrange(1, 3), name(c), 1 if c % 3 else rng.randrange(1, 9)) for c in range(3000)], f"sample int, cell {kind}, umis int")
        w = Window.partitionBy("sample").orderBy(F.col("total").desc(), "cell")
        want = counts.groupBy("sample", "cell").agg(F.sum("umis").alias("total")).withColumn("rank", F.row_number().over(w).cast("long"))
        for cells in (7, 4096):
            assert rows_of(S.ranked_cells(counts, cells).select("sample", "cell", "total", "rank")) == rows_of(want)
    assert S.ranked_cells(counts.limit(0)).count() == 0


def test_summary_of_equal_sequences(spark):
    rows = [(f"t{i}", "ACGT") for i in range(300)] + [(f"u{i}", "A" * i) for i in range(600)] + [("t5", "ACGT"), ("x", None), ("y", None), ("", "acgt"), ("u7", "A" * 7)]
    got = R.fasta_summary(spark.createDataFrame(rows, "transcript_id string, seq string"))
    w = Window.partitionBy("md5")
    d = spark.createDataFrame(rows, "transcript_id string, seq string").select("transcript_id", F.length("seq").alias("length"), F.md5(F.upper("seq")).alias("md5"))
    named = d.filter("md5 is not null").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("again", F.row_number().over(w.orderBy("transcript_id")) > 1)
    assert rows_of(got.filter("md5 is not null")) == rows_of(named.select("transcript_id", "length", "md5", F.col("n") == 1, "n", "again"))
    assert rows_of(got.filter("md5 is null").select("transcript_id", "is_unique", "occurrence", "duplicated")) == [("x", True, 1, False), ("y", True, 1, False)]


def test_islands_in_bins(spark):
    rng = random.Random(3)
    for most in (60, 3000):
        rows = [(rng.choice("aaab"), s := rng.randrange(1, most * 8), s + rng.choice([0, 1, 5, 40, 400])) for _ in range(most)] * 2
        df = spark.createDataFrame(rows, "chr string, start int, end int")
        for gap in (1, 5):
            merged = lambda x: rows_of(x.groupBy("chr", "__island").agg(F.min("start"), F.max("end"), F.count(F.lit(1))).drop("__island"))
            want = merged(I.islands(df, ["chr"], gap=gap))
            for width in (3, 64, 1 << 20):
                assert merged(I.islands_in_bins(df, ["chr"], gap=gap, width=width)) == want
    assert I.islands_in_bins(df.limit(0), ["chr"]).count() == 0


def test_clusters_at_one_place(spark):
    pairs = [("translocation", "c1", 100 + i % 3, "c2", 900 + i % 5) for i in range(400)] + [("deletion", "c1", 5000 * i, "c1", 5000 * i + 2000) for i in range(1, 20)] + [("deletion", "c1", 5100, "c1", 7900)]
    got = {tuple(r[c] for c in ("kind", "chr1", "pos1", "end1", "chr2", "pos2", "end2", "support")) for r in E.breakpoint_clusters(spark.createDataFrame(pairs, "kind string, chr1 string, pos1 int, chr2 string, pos2 int")).collect()}
    want = {("translocation", "c1", 100, 102, "c2", 900, 904, 400), ("deletion", "c1", 5000, 5000, "c1", 7000, 7000, 1), ("deletion", "c1", 5100, 5100, "c1", 7900, 7900, 1)}
    assert got == want | {("deletion", "c1", 5000 * i, 5000 * i, "c1", 5000 * i + 2000, 5000 * i + 2000, 1) for i in range(2, 20)}
    events = spark.createDataFrame([("c1", p, "I", 1, p % 7) for p in range(10, 2000, 4)] + [("c1", 9000, "D", 2, 1), ("c2", 9000, "D", 2, 1)], "chr string, pos int, kind string, length int, support int")
    assert rows_of(E.prune_neighbours(events).select("chr", "pos", "support")) == [("c1", 34, 6), ("c1", 9000, 1), ("c2", 9000, 1)]
