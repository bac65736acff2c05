from __future__ import annotations

import random

from pyspark.sql import functions as F

from readloom.operators import intervals as I

KEYS = ["gene_id", "chr", "strand"]


def exons(spark, ranges, gene="g", transcript="t"):
    return spark.createDataFrame([(gene, transcript, "chr1", a, b, "+") for a, b in ranges], "gene_id string, transcript_id string, chr string, start int, end int, strand string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merge_and_chop_of_three_exons(spark):
    e = exons(spark, [(100, 200), (150, 500), (250, 400)])
    assert rows(I.merge_intervals(e, KEYS), "start", "end") == [(100, 500)]
    assert rows(I.chop_intervals(e, KEYS), "start", "end") == [(100, 149), (150, 200), (201, 249), (250, 400), (401, 500)]


def test_adjacent_ranges_merge_and_apart_ones_do_not(spark):
    e = exons(spark, [(1, 10), (11, 20), (22, 30)])
    assert rows(I.merge_intervals(e, KEYS), "start", "end") == [(1, 20), (22, 30)]
    assert rows(I.gaps(e, ["chr"]), "start", "end") == [(21, 21)]
    assert rows(I.union_length(e, KEYS), "length") == [(29,)]


def test_chop_covers_what_merge_covers(spark):
    rng = random.Random(3)
    some = [(a, a + rng.randrange(80)) for a in (rng.randrange(1, 2000) for _ in range(60))]
    e = exons(spark, some)
    bases = lambda rs: sorted({p for a, b in rs for p in range(a, b + 1)})
    assert bases(rows(I.chop_intervals(e, KEYS), "start", "end")) == bases(rows(I.merge_intervals(e, KEYS), "start", "end")) == bases(some)


def test_overlap_join_equals_plain_join(spark):
    rng = random.Random(5)
    a = [(i, f"c{rng.randrange(2)}", s, s + rng.randrange(200)) for i, s in enumerate(rng.randrange(1, 30000) for _ in range(300))]
    b = [(i, f"c{rng.randrange(2)}", s, s + rng.choice([5, 300, 20000])) for i, s in enumerate(rng.randrange(1, 30000) for _ in range(80))]
    left, right = spark.createDataFrame(a, "i int, chr string, start int, end int"), spark.createDataFrame(b, "j int, chr string, f_start int, f_end int")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    for width in (16, 64, 2048):
        assert rows(I.overlap_join(left, right, ["chr"], bin_width=width), "i", "j") == want


def test_transcript_unique_bases(spark):
    e = exons(spark, [(1, 100), (201, 300)], transcript="a").union(exons(spark, [(51, 150)], transcript="b"))
    assert rows(I.unique_transcript_bases(e), "transcript_id", "unique_bases", "all_bases") == [("a", 150, 200), ("b", 50, 100)]


def test_promoters_and_bins(spark):
    e = exons(spark, [(100, 200), (500, 900)])
    assert rows(I.promoter_regions(e, 300, 50), "start", "end") == [(1, 150)]
    minus = e.withColumn("strand", F.lit("-"))
    assert rows(I.promoter_regions(minus, 300, 50), "start", "end") == [(850, 1200)]
    assert rows(I.fixed_bins(exons(spark, [(11, 45)]), 10), "start", "end") == [(11, 20), (21, 30), (31, 40)]


def test_process_exons(spark):
    a = spark.createDataFrame([("ref", "CDS", "1", 10, 20, "+", "g"), ("ref", "UTR", "1", 21, 30, "+", "g"), ("alt", "CDS", "1", 40, 50, "+", "g"), ("ref", "RNA", "1", 1, 99, "+", "g")], "group_label string, feature_type string, chr string, start int, end int, strand string, gene_id string")
    assert rows(I.process_exons(a, "ref", {"1": "chr1"}), "chr", "start", "end") == [("chr1", 10, 30)]
