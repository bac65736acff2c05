"""Queries and operators do the whole job: no prefix, id subset, fixed number or rank cap."""

from __future__ import annotations

from collections import Counter

from readloom import plans  # noqa: F401  # registers the queries
from readloom.plans import registry as Q

SF = "/root/testdata/sf0.001"


def test_pileup_counts_whole_texts(spark, tmp_path):
    texts = ["acgt" * 40 + "xyz", "TTTTTTT", "acg", "é" + "Cc" * 90, None]
    spark.createDataFrame(list(enumerate(texts, 18)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for k, t in enumerate(texts, 18):
        for i, b in enumerate(t or ""):
            if 3 <= i < len(t) - 3 and b.upper() in "ACGT":
                want[k % 20 + i + 1, b.lower()] += 1
    got = Q.QUERIES["pileup_counts"](spark, str(tmp_path)).collect()
    assert {(r["pos"], b): r[b] for r in got for b in "acgt" if r[b]} == want and max(r["pos"] for r in got) > 150


def test_unique_bases_of_all_exons(spark, tmp_path):
    parts = [(k, k % 50 + 1, f"B{k % 7}") for k in range(1, 2201)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    by = {}
    for k, size, brand in parts:
        start = k * 50 + (k % 3) * 20
        for p in range(start, start + size * 6 + 1):
            by.setdefault((f"chr{k % 5}", "+-"[k % 2], p), set()).add(brand)
    every, alone = Counter(), Counter()
    for (gene, _, _), brands in by.items():
        for b in brands:
            every[gene, b] += 1
            alone[gene, b] += len(brands) == 1
    got = Q.QUERIES["transcript_unique_bases"](spark, str(tmp_path)).collect()
    assert {(r["gene_id"], r["transcript_id"]): (r["unique_bases"], r["all_bases"]) for r in got} == {k: (alone[k], n) for k, n in every.items()}


def test_reads_of_whole_contigs_grow_with_them_and_map(spark):
    assert Q.QUERIES["simulated_reads"](spark, "/root/testdata/sf0.01").count() == 10 * 1000
    truth = Q.QUERIES["simulated_reads"](spark, SF).select("name", "transcript_id", "start", "fragment_length")
    got = Q.QUERIES["aligned_reads"](spark, SF).join(truth.withColumnRenamed("name", "rid"), "rid").collect()
    assert len(got) == 10 * 200 and max(r["start"] for r in got) > 2300
    assert all(r["nm"] == 0 and r["chr"] == r["transcript_id"] and r["pos"] in (r["start"], r["start"] + r["fragment_length"] - 75) for r in got)
