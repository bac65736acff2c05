from __future__ import annotations

from readloom.operators import events as E


def test_events(spark):
    rows = [(0, "c", 1, "5M2I5M"), (0, "c", 1, "5M2I5M"), (0, "c", 2, "6M1D5M"), (0, "c", 1, "12M"), (4, "*", 0, "*")]
    a = spark.createDataFrame(rows, "flag int, chr string, pos int, cigar string")
    ev = E.indel_events(a)
    assert sorted(map(tuple, ev.collect())) == [("c", 5, "I", 2, 2), ("c", 7, "D", 1, 1)]
    assert [r["pos"] for r in E.prune_neighbours(ev).collect()] == [5]
    assert sorted((r["pos"], r["against"]) for r in E.anti_support(ev, a).collect()) == [(5, 2), (7, 3)]


def test_introns_and_clusters(spark):
    x = spark.createDataFrame([("g", "t", "c", "+", 1, 10), ("g", "t", "c", "+", 21, 30)], "gene_id string, transcript_id string, chr string, strand string, start int, end int")
    introns = E.annotated_introns(x)
    assert [tuple(r) for r in introns.collect()] == [("c", 10, 21)]
    found = spark.createDataFrame([("c", 10, 21, 4), ("c", 10, 40, 1)], "chr string, left int, right int, support int")
    assert sorted((r["right"], r["support"], r["known"]) for r in E.guided_junctions(found, introns).collect()) == [(21, 4, True), (40, 1, False)]
    bp = spark.createDataFrame([("deletion", "c", 100, "c", 9000), ("deletion", "c", 300, "c", 9100), ("deletion", "c", 200, "c", 20000)], "kind string, chr1 string, pos1 int, chr2 string, pos2 int")
    assert sorted((r["pos1"], r["end1"], r["support"]) for r in E.breakpoint_clusters(bp).collect()) == [(100, 300, 2), (200, 200, 1)]
