from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from readloom.functions import stats
from readloom.operators import align as A
from readloom.operators import readtools as R
from readloom.operators import singlecell as S
from readloom.operators import variants as V
from readloom.operators.simulate import length_weights, simulate_reads


def test_fisher_poisson_and_others():
    a, b, c, d = 8, 2, 1, 5
    want = sum(math.comb(10, k) * math.comb(6, 9 - k) for k in range(8, 10)) / math.comb(16, 9)
    assert abs(stats.fisher_one_sided(a, b, c, d) - want) < 1e-12
    assert stats.fisher_one_sided(1, 9, 9, 1) == 1.1
    p = sum(math.exp(-3) * 3**k / math.factorial(k) for k in range(5, 60)) + 0.5 * math.exp(-3) * 3**4 / 24
    assert abs(stats.poisson_tail(np.array([4.0]), np.array([3.0]), np.array([0.5]))[0] - p) < 1e-9
    assert abs(stats.log_factorial(np.array([5000.0]))[0] - math.lgamma(5001)) < 1e-6
    x = np.linspace(0, 1, 30)
    assert np.allclose(stats.lowess(x, 2 * x + 1), 2 * x + 1)
    assert np.allclose(stats.benjamini_hochberg(np.array([0.01, 0.04, 0.03, 0.5])), [0.04, 0.16 / 3, 0.16 / 3, 0.5])
    share = stats.good_turing(np.array([0, 0, 1, 1, 1, 1, 2, 2, 3, 4, 5, 9]))
    assert abs(share.sum() - 1) < 1e-9 and share[0] > 0


def test_sampling_takes_about_as_many_as_asked(spark):
    df = spark.range(1000).withColumnRenamed("id", "ordinal").withColumn("flag", F.lit(0)).withColumn("qual", F.when(F.col("ordinal") % 2 == 0, "II").otherwise("5"))
    got = R.quality_scores(df, 100).collect()
    assert 95 <= len(got) <= 101 and {len(r["scores"]) for r in got} == {2} and got[0]["scores"][0] in (40, 20)


def test_duplicates_and_repair(spark):
    schema = "file string, qname string, flag int, chr string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, hi int"
    rows = [("f", "a", 65, "c", 5, 9, "4M", "=", 50, 49, "ACGT", "IIII", None), ("f", "a", 129, "c", 50, 9, "4M", "=", 5, -49, "ACGT", "IIII", None), ("f", "b", 65, "c", 5, 9, "4M", "=", 70, 60, "ACGT", "IIII", None)]
    df = spark.createDataFrame(rows, schema)
    assert R.remove_duplicate_positions(df, 2).count() == 1
    got = R.repair(df).collect()
    assert len(got) == 4 and sorted((r["qname"], r["end"], r["dummy"]) for r in got) == [("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", 2, True)]
    prop = R.proportion_mapped(df).first()
    assert (prop["num_total"], prop["num_mapped"]) == (2, 2)


def test_detection(spark):
    bg = spark.createDataFrame([(i / 100, 4.0) for i in range(100)], "gc_percent double, count double")
    genes = spark.createDataFrame([("hi", 2000, 0.5, 500), ("lo", 2000, 0.5, 3)], "gene_id string, length int, gc_percent double, reads int")
    got = {r["gene_id"]: r for r in R.detection_call(genes, bg).collect()}
    assert abs(got["lo"]["expected"] - 4) < 1e-6 and got["hi"]["p_value"] < 1e-9 < 0.2 < got["lo"]["p_value"]


def test_snps_stand_out(spark):
    rows = [("c", p, "A", 50, 0, 0, 0) for p in range(1, 40) if p != 20] + [("c", 20, "A", 25, 25, 0, 0)]
    piled = spark.createDataFrame(rows, "chr string, pos long, ref string, a long, c long, g long, t long").withColumn("depth", F.col("a") + F.col("c") + F.col("g") + F.col("t"))
    got = V.call_snps(piled).collect()
    assert [(r["pos"], r["alt"]) for r in got] == [(20, "C")] and "DP=50;MMsum=25;MM=25" in got[0]["info"]
    known = spark.createDataFrame([("c", 20)], "chr string, pos long")
    near = {r["pos"]: r["bg_mismatch"] for r in V.background(piled, known).collect()}
    assert near[19] == 0


def test_mates_keep_the_better_base(spark):
    rows = [("f", 1, "c", 1, 0, "4M", "ACGT", "I5II"), ("f", 2, "c", 1, 0, "4M", "AGGT", "IIII")]
    df = spark.createDataFrame(rows, "fid string, end int, chr string, pos int, flag int, cigar string, seq string, qual string")
    got = {r["pos"]: r["base"] for r in V.mates_resolved(V.aligned_bases(df, V.SnpOptions(trim=0))).collect()}
    assert got == {1: "A", 2: "G", 3: "G", 4: "T"}


def test_umis(spark):
    rows = [(1, 1, "g", "AAAA", 9), (1, 1, "g", "AAAC", 2), (1, 1, "g", "CCCC", 5), (1, 1, "h", "CCCC", 5), (1, 1, "h", "AAAA", 3)]
    e = spark.createDataFrame(rows, "sample int, cell int, gene string, umi string, reads long")
    merged = S.merge_umis(e)
    assert sorted((r["gene"], r["umi"], r["reads"]) for r in merged.collect()) == [("g", "AAAA", 11), ("g", "CCCC", 5), ("h", "AAAA", 3), ("h", "CCCC", 5)]
    assert [(r["gene"], r["umi"]) for r in S.resolve_genes(merged).collect()] == [("g", "AAAA")]


def test_demultiplex(spark):
    sheet = spark.createDataFrame([(1, "s1", "AAAA", None, None), (2, "s2", "AAAC", None, None)], "ordinal int, sample string, s_index1 string, s_index2 string, s_lane int")
    reads = spark.createDataFrame([("AAAC", None, 1), ("AACC", None, 1), ("TTTT", None, 1)], "index1 string, index2 string, lane int")
    assert [r["sample"] for r in S.demultiplex(reads, sheet).orderBy("index1").collect()] == ["s1", "s2", None]


def test_cells(spark):
    rng = np.random.default_rng(0)
    assert S.high_confidence_count(np.sort(np.r_[rng.integers(900, 1100, 200), rng.integers(1, 20, 2000)])[::-1]) in range(190, 211)
    counts = spark.createDataFrame([(1, c, f"g{g}", 1 + (c % 3)) for c in range(20) for g in range(10)], "sample int, cell int, gene string, umis long")
    called = S.call_cells(counts, cutoff=25)
    stats_ = S.sample_stats(called).first()
    assert stats_["total_cells"] == 6 and stats_["median_umi"] == 30
    ranks = sorted(r["rank"] for r in called.collect())
    assert ranks == list(range(1, 21))
    odd = spark.createDataFrame([(1, 99, "g0", 40)], "sample int, cell int, gene string, umis long")
    even = spark.createDataFrame([(1, 98, f"g{g}", 4) for g in range(10)], "sample int, cell int, gene string, umis long")
    ambient = spark.createDataFrame([(1, f"g{g}", 100 + g) for g in range(10)], "sample int, gene string, umis long")
    both = odd.union(even)
    cand = both.groupBy("sample", "cell").agg(F.sum("umis").alias("total"))
    got = {r["cell"]: r["rescued"] for r in S.rescue(both, cand, ambient, simulations=2000).collect()}
    assert got == {99: True, 98: False}


def genome(n, seed=4):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_simulated_reads_map_back(spark):
    g = genome(6000)
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1000 + 300]) for a in range(0, 6000, 1000)], "chr string, start long, seq string")
    tx = spark.createDataFrame([("t1", g[1000:2000], 1.0), ("t2", g[3000:4500], 2.0), ("t3", "ACGT", 5.0)], "transcript_id string, seq string, expression double")
    sim = simulate_reads(tx, 150, 75, paired=True)
    assert sim.count() == 300 and sim.filter("transcript_id = 't3'").count() == 0
    index = A.build_index(chunks, chunk=1000)
    assert index.count() == 6000 - 15
    offset = F.when(F.col("transcript_id") == "t1", 1000).otherwise(3000)
    reads = sim.withColumn("rid", F.concat_ws("/", "name", "mate")).withColumn("from", offset + F.col("start")).withColumn("to", offset + F.col("start") + F.col("fragment_length") - 1)
    o = A.AlignOptions()
    got = A.align(reads.select("rid", "seq", "qual"), index, chunks, o, 1000).join(reads.select("rid", "from", "to"), "rid").collect()
    assert len(got) == 300 and all(r["from"] <= r["pos"] <= r["to"] and r["cigar"] == "75M" and r["nh"] == 1 and r["mapq"] == 40 for r in got)
    ends = [A.align(reads.filter(f"mate = {m}").select(F.col("name").alias("rid"), "seq", "qual"), index, chunks, o, 1000) for m in (1, 2)]
    assert all(r["proper"] for r in A.pair_up(*ends).collect())


def test_indels_junctions_and_unmapped(spark):
    g = genome(5000)
    g = g[:2000] + "GT" + g[2002:2998] + "AG" + g[3000:]
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1000 + 300]) for a in range(0, 5000, 1000)], "chr string, start long, seq string")
    reads = [("del", g[500:550] + g[553:603]), ("ins", g[700:740] + "AC" + g[740:798]), ("junc", g[1950:2000] + g[3000:3050]), ("none", genome(100, 9)), ("same", g[100:200])]
    df = spark.createDataFrame([(n, s, "I" * len(s)) for n, s in reads], "rid string, seq string, qual string")
    got = {r["rid"]: r for r in A.align(df, A.build_index(chunks, chunk=1000), chunks, A.AlignOptions(junctions=True), 1000).collect()}
    assert got["same"]["cigar"] == "100M" and got["none"]["flag"] == 4
    assert (got["junc"]["pos"], got["junc"]["cigar"]) == (1951, "50M1000N50M")
    assert "D" in got["del"]["cigar"] and got["del"]["pos"] == 501 and "I" in got["ins"]["cigar"] and got["ins"]["pos"] == 701


def test_length_weights():
    p = length_weights(180, 40, 110, 400)
    assert abs(p.sum() - 1) < 1e-12 and abs((p * np.arange(110, 401)).sum() - 185) < 10


def test_umis_merge_as_one_by_one(spark):
    rng = random.Random(11)
    rows = list({(1, c, g, "".join(rng.choice("ACGT") for _ in range(5))): rng.randrange(1, 9) for c in (1, 2) for g in "ab" for _ in range(150)}.items())
    rows = [(*k, n) for k, n in rows]
    want = []
    for c in (1, 2):
        for g in "ab":
            kept = []
            for umi, n in sorted(((r[3], r[4]) for r in rows if r[1:3] == (c, g)), key=lambda x: (-x[1], x[0])):
                near = next((k for k in kept if sum(a != b for a, b in zip(k[0], umi)) == 1), None)
                if near:
                    near[1] += n
                else:
                    kept.append([umi, n])
            want += [(1, c, g, u, n) for u, n in kept]
    df = spark.createDataFrame(rows, "sample int, cell int, gene string, umi string, reads long")
    assert sorted(map(tuple, S.merge_umis(df).collect())) == sorted(want)
