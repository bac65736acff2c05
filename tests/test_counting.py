from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import dna
from readloom.operators import counting as C

ALN = "file string, qname string, flag int, chr string, pos int, mapq int, cigar string, tlen int, nh int, hi int"


def features(spark):
    rows = [(1, "gene1", "chr_dummy", 100, 500, "+"), (2, "gene1", "chr_dummy", 1000, 1800, "+"), (3, "gene2", "chr_dummy", 3000, 4000, "-"), (4, "gene2", "chr_dummy", 5000, 5500, "-"), (5, "gene3", "chr_dummy", 3900, 4100, "+")]
    return spark.createDataFrame(rows, "feature_id long, gene_id string, chr string, start int, end int, strand string")


def single(spark, *reads):
    rows = [("f", f"r{i}", flag, "chr_dummy", pos, mapq, cigar, 0, nh, None) for i, (flag, pos, cigar, mapq, nh) in enumerate(reads)]
    return C.single_fragments(spark.createDataFrame(rows, ALN), "qname")


def outcome(spark, reads, **options):
    got = C.assign(single(spark, *reads), features(spark), C.CountOptions(**options)).collect()
    return [(r["status"].removeprefix("Unassigned_"), r["targets"], r["units"]) for r in sorted(got, key=lambda r: int(r["fid"][1:]))]


def test_touching_is_not_overlapping_and_one_base_is(spark):
    reads = [(0, 50, "50M", 30, 1), (0, 50, "51M", 30, 1), (0, 500, "10M", 30, 1), (0, 501, "10M", 30, 1), (4, 150, "10M", 0, 1)]
    assert [o[0] for o in outcome(spark, reads)] == ["NoFeatures", "Assigned", "Assigned", "NoFeatures", "Unmapped"]


def test_two_genes_are_ambiguous_two_exons_of_one_are_not(spark):
    reads = [(0, 3950, "40M", 30, 1), (0, 490, "11M499N20M", 30, 1)]
    assert outcome(spark, reads) == [("Ambiguity", [], 0), ("Assigned", ["gene1"], 65536)]
    assert outcome(spark, reads, gene_level=False)[1][0] == "Ambiguity"
    assert outcome(spark, reads, allow_multi_overlap=True, fraction=True)[0] == ("Assigned", ["gene2", "gene3"], 32768)
    assert outcome(spark, reads, strand=1)[0] == ("Assigned", ["gene3"], 65536)
    assert outcome(spark, [(0, 3880, "100M", 30, 1)], largest_overlap=True)[0] == ("Assigned", ["gene2"], 65536)


def test_first_rule_names_the_status(spark):
    reads = [(1024, 150, "10M", 3, 4), (1024, 150, "10M", 30, 4), (0, 150, "10M", 30, 4), (256, 150, "10M", 30, 1)]
    assert [o[0] for o in outcome(spark, reads, min_mapq=10, ignore_dup=True, count_multi_mapping=False, primary_only=True, primary_ignores_multi=False)] == ["MappingQuality", "Duplicate", "MultiMapping", "Secondary"]
    assert [o[0] for o in outcome(spark, reads, primary_only=True, count_multi_mapping=False)] == ["Assigned", "Assigned", "Assigned", "Secondary"]


def test_weights_are_whole_parts(spark):
    assert outcome(spark, [(0, 150, "10M", 30, 3)], fraction=True)[0][2] == 65536 // 3


def test_lengths_and_fractions(spark):
    reads = [(0, 91, "20M", 30, 1)]  # 11 of 20 bases on gene1
    assert outcome(spark, reads, frac_overlap=0.55)[0][0] == "Assigned"
    assert outcome(spark, reads, frac_overlap=0.56)[0][0] == "Overlapping_Length"
    assert outcome(spark, reads, non_overlap=8)[0][0] == "Overlapping_Length"
    assert outcome(spark, reads, frac_overlap_feature=0.5)[0][0] == "NoFeatures"
    assert outcome(spark, [(0, 490, "11M499N20M", 30, 1)], frac_overlap=1.0)[0][0] == "Assigned"


def test_geometry(spark):
    assert outcome(spark, [(0, 510, "10M", 30, 1)], shift=20)[0][0] == "Assigned"
    assert outcome(spark, [(16, 510, "10M", 30, 1)], shift=20)[0][0] == "NoFeatures"
    assert outcome(spark, [(0, 510, "10M", 30, 1)], extend_5=15)[0][0] == "Assigned"
    assert outcome(spark, [(16, 510, "10M", 30, 1)], extend_5=15)[0][0] == "NoFeatures"
    assert outcome(spark, [(16, 495, "10M", 30, 1)], reduce_to=5)[0][0] == "NoFeatures"


def pair(spark, a, b, **options):
    rows = [("f", "p", flag, chrom, pos, 30, "20M", tlen, 1, None) for flag, chrom, pos, tlen in (a, b) if flag is not None]
    got = C.assign(C.fragments_of(spark.createDataFrame(rows, ALN), ["file", "qname"]), features(spark), C.CountOptions(paired=True, **options)).collect()
    assert len(got) == 1
    return got[0]["status"].removeprefix("Unassigned_")


def test_pairs(spark):
    good = ((1 + 64, "chr_dummy", 150, 300), (1 + 16 + 128, "chr_dummy", 430, -300))
    assert pair(spark, *good) == "Assigned"
    assert pair(spark, *good, check_length=True, max_length=200) == "FragmentLength"
    assert pair(spark, good[0], (1 + 128, "chr_dummy", 430, -300), count_chimeric=False) == "Chimera"
    assert pair(spark, good[0], (1 + 128, "chr9", 430, 0), count_chimeric=False) == "Chimera"
    assert pair(spark, good[0], (1 + 4 + 128, "*", 0, 0), both_ends=True) == "Singleton"
    assert pair(spark, good[0], (1 + 4 + 1024 + 128, "*", 0, 0), ignore_dup=True) == "Duplicate"
    # end 1 hits both genes, end 2 only one of them: that one is hit twice
    assert pair(spark, (65, "chr_dummy", 3950, 0), (145, "chr_dummy", 3500, 0)) == "Assigned"


def test_statuses_add_up_and_units_too(spark):
    reads = [(0, 50 * i, "60M", 30, 1 + i % 3) for i in range(120)]
    got = C.assign(single(spark, *reads), features(spark), C.CountOptions(fraction=True))
    assert C.summary_table(got).agg(F.sum("n")).first()[0] == 120
    assert C.count_table(got).agg(F.sum("units")).first()[0] == got.agg(F.sum("units")).first()[0]


def test_sections_and_junctions(spark):
    df = spark.createDataFrame([("2S10M2I5M3D4M100N6M1H", 100)], "cigar string, pos int").select(dna.cigar_sections(F.col("cigar"), F.col("pos")).alias("s"))
    assert [tuple(x) for x in df.first()["s"]] == [(100, 109, 2, "I"), (110, 114, 14, "D"), (118, 121, 19, "N"), (222, 227, 23, None)]
    found = C.junctions(single(spark, (0, 490, "11M499N20M", 30, 1), (0, 490, "11M499N20M", 0, 9), (0, 495, "6M699N20M", 30, 1)))
    counts = C.junction_counts(found)
    assert sorted((r["left"], r["right"], r["support"]) for r in counts.collect()) == [(500, 1000, 2), (500, 1200, 1)]
    exons = features(spark).withColumn("transcript_id", F.col("gene_id"))
    assert sorted((r["right"], r["status"]) for r in C.classify_junctions(counts, exons).collect()) == [(1000, "KNOWN"), (1200, "NOVEL")]


def test_tables_and_chromosome_names(spark):
    counts = C.count_table(C.assign(single(spark, (0, 150, "10M", 30, 1)), features(spark)))
    got = {r["gene_id"]: (r["start"], r["length"], r["count"]) for r in C.gene_table(features(spark), counts).collect()}
    assert got["gene1"] == ("100;1000", 401 + 801, 1.0) and got["gene3"][2] == 0.0
    known, seen = spark.createDataFrame([("chr1",), ("2",), ("x",)], "chr string"), spark.createDataFrame([("1",), ("chr2",), ("chr1",), ("MT",), ("odd",)], "rname string")
    alias = spark.createDataFrame([("x", "odd")], "chr string, rname string")
    assert {r["rname"]: r["chr"] for r in dna.chromosome_match(seen, known, alias).collect()} == {"1": "chr1", "chr2": "2", "chr1": "chr1", "odd": "x"}


def test_equal_records_are_counted_before_they_are_numbered(spark, monkeypatch):
    # 70 and 50 records of end 1 in two kinds, 45 and 90 of end 2: pairs by rank, 15 ends without a mate
    rows = [("f", "r", f, "c", p, 9, "4M", 0, 1, None) for f, p, n in ((65, 10, 70), (65, 20, 50), (129, 30, 45), (129, 40, 90)) for _ in range(n)] + [("f", "s", 129, "c", 7, 9, "4M", 0, 1, None)]
    df = spark.createDataFrame(rows, ALN).repartition(3)
    for most in (4096, 8):
        monkeypatch.setattr(C, "EQUAL", most)
        got = C.fragments_of(df, ["qname"])
        found = [(r["fid"], r["r1"] and r["r1"]["pos"], r["r2"] and r["r2"]["pos"]) for r in got.collect()]
        want = [(10, 30)] * 45 + [(10, 40)] * 25 + [(20, 40)] * 50 + [(None, 40)] * 15
        assert sorted(found, key=repr) == sorted([("s", None, 7)] + [("r" if i == 0 else f"r\x1f{i + 1}", *w) for i, w in enumerate(want)], key=repr)
        with_many = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("RepartitionByExpression" in with_many) == (most == 8)


def test_single_ends_of_pairs_need_no_numbers(spark):
    rows = [("f", "r", 65, "c", 10, 9, "4M", 0, 1, None), ("f", "r", 129, "c", 30, 9, "4M", 0, 1, None), ("f", "s", 129, "c", 7, 9, "4M", 0, 1, None)]
    got = [C.fragments_of(spark.createDataFrame(rows, ALN), ["file", "qname"], single=one).orderBy("fid").collect() for one in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 2
