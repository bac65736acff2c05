from __future__ import annotations

import gzip
import random

import pytest

from readloom.sources import bam, files, sequences, tables

SAM = """@HD\tVN:1.6
@SQ\tSN:c1\tLN:1000
r1\t99\tc1\t10\t40\t5M2N3M\t=\t50\t48\tACGTACGT\tIIIIIIII\tNH:i:2\tHI:i:1\tRG:Z:a
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII
"""


def test_sam_and_probe(spark, tmp_path):
    path = tmp_path / "a.sam"
    path.write_text(SAM)
    a, b = tables.read_sam(spark, str(path)).orderBy("qname").collect()
    assert (a["flag"], a["chr"], a["pos"], a["cigar"], a["nh"], a["hi"], a["rg"], a["tlen"]) == (99, "c1", 10, "5M2N3M", 2, 1, "a", 48)
    assert (b["chr"], b["nh"], b["rg"]) == ("*", 1, None)
    assert files.probe(str(path)) == "sam"
    lines = sorted(r[0] for r in tables.sam_lines(tables.read_sam(spark, str(path))).collect())
    assert lines == sorted(SAM.strip().split("\n")[2:])


def test_annotation(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#x\nc1\ts\texon\t5\t9\t.\t-\t.\tgene_id "g1"; transcript_id "t1";\nc1\ts\tCDS\t5\t9\t.\t+\t.\tgene_id "g1";\nc1\ts\texon\t20\t29\t.\t.\t.\tgene_id "g 2"; transcript_id "t2";\n')
    got = sorted((r["gene_id"], r["start"], r["end"], r["strand"], r["transcript_id"]) for r in tables.read_gtf(spark, str(gtf), extra=("transcript_id",)).collect())
    assert got == [("g 2", 20, 29, "+", "t2"), ("g1", 5, 9, "-", "t1")]
    with pytest.raises(Exception, match="no gene_name"):
        tables.read_gtf(spark, str(gtf), gene_attribute="gene_name").collect()
    saf = tmp_path / "a.saf"
    saf.write_text("GeneID\tChr\tStart\tEnd\tStrand\ng\tc\t1\t2\t+\n")
    assert tables.read_saf(spark, str(saf)).first()["gene_id"] == "g" and files.probe(str(saf)) == "saf"
    with pytest.raises(ValueError, match="strand"):
        tables.saf(spark.createDataFrame([("g", "c", 1, 2)], "GENEID string, chr string, start int, end int"))


def test_fastq_splits_see_each_record_once(spark, tmp_path):
    rng = random.Random(1)
    recs = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+I5") for _ in range(n))) for i, n in enumerate(rng.randrange(1, 40) for _ in range(300))]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in recs)
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    for split in (64, 1000, 1 << 20):
        got = sequences.read_fastq(spark, str(tmp_path / "a.fastq"), split)
        assert sorted((r["name"], r["seq"], r["qual"]) for r in got.collect()) == sorted(recs)
    assert sequences.read_fastq(spark, str(tmp_path / "b.fastq.gz"), 64).count() == 300
    assert files.probe(str(tmp_path / "b.fastq.gz")) == "fastq.gz"


def test_fasta_chunks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 x\nACGTA\nCGT\n>c2\nAA\n")
    got = sorted((r["chr"], r["start"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa"), 4, 2).collect())
    assert got == [("c1", 1, "ACGTAC"), ("c1", 5, "ACGT"), ("c2", 1, "AA")]


def test_bam_round_trip_over_splits(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        n = rng.randrange(20, 60)
        tags = {"NH": str(rng.randrange(1, 4)), "RG": "a"} if i % 2 else {}
        rows.append((f"read{i}", 16 * (i % 2), "c1" if i % 3 else "c2", i + 1, 30, f"{n}M", "=", 5, 0, "".join(rng.choice("ACGTN") for _ in range(n)), "".join(chr(rng.randrange(35, 70)) for _ in range(n)), tags))
    schema = "qname string, flag int, chr string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    (path,) = bam.write_bam(df, str(tmp_path / "out"), {"c1": 9000, "c2": 9000})
    assert files.probe(path) == "bam"
    for split in (1 << 30, 50_000, 7000):
        got = bam.read_bam(spark, path, split).collect()
        assert sorted((r["qname"], r["flag"], r["chr"], r["pos"], r["cigar"], r["rnext"], r["seq"], r["qual"], r["nh"]) for r in got) == sorted((r[0], r[1], r[2], r[3], r[5], r[6], r[9], r[10], int(r[11].get("NH", 1))) for r in rows)


def test_vcf_alias_matrix_and_sinks(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc1\t5\t.\tA\tC,T\t9.5\t.\tDP=2\textra\n")
    r = tables.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (r["chrom"], r["pos"], r["alt"], r["qual"], r["info"], r["file"]) == ("c1", 5, "C,T", 9.5, "DP=2", "a.vcf")
    (tmp_path / "alias").write_text("#x\nc1,1\n")
    assert tuple(tables.read_aliases(spark, str(tmp_path / "alias")).first()) == ("c1", "1")
    counts = spark.createDataFrame([("g1", "x", 3), ("g2", "x", 1), ("g1", "y", 2)], "gene string, cell string, umis long")
    tables.write_matrix_market(counts, str(tmp_path / "m"))
    assert sorted(map(tuple, tables.read_matrix_market(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, counts.collect()))
    bnd = tables.breakpoint_rows(spark.createDataFrame([(1, "c1", 5, "c2", 9, True, 4)], "id int, chr1 string, pos1 int, chr2 string, pos2 int, same_strand boolean, support int")).collect()
    assert sorted((b["chrom"], b["pos"], b["alt"]) for b in bnd) == [("c1", 5, "N[c2:9["), ("c2", 9, "N[c1:5[")]
    bed = tables.junction_bed(spark.createDataFrame([("c1", 10, 21, 4, "+")], "chr string, left int, right int, support int, strand string")).first()
    assert (bed["start"], bed["end"], bed["starts"]) == (9, 21, "0,11")


def test_tags_keep_their_types(spark, tmp_path):
    tags = "XI:i:-7\tXU:i:4000000000\tXF:f:0.1\tXA:A:q\tXZ:Z:123456789012345678901\tXB:B:s,1,-2,3\tXH:H:1AE3\tXN:Z:12"
    path = tmp_path / "a.sam"
    path.write_text(f"@SQ\tSN:c1\tLN:1000\nr1\t0\tc1\t10\t40\t4M\t*\t0\t0\tACGT\tIIII\t{tags}\n")
    one = tables.read_sam(spark, str(path))
    bam.write_bam(one, str(tmp_path / "b"), {"c1": 1000})
    back = bam.read_bam(spark, next(str(p) for p in (tmp_path / "b").iterdir() if p.suffix == ".bam"))
    for df in (one, back):
        assert sorted(tables.sam_lines(df).first()[0].split("\t")[11:]) == sorted(tags.split("\t"))
    # without types: numbers where they fit
    bam.write_bam(one.drop("kinds"), str(tmp_path / "c"), {"c1": 1000})


def test_sorted_files_follow_the_header(spark, tmp_path):
    rows = [(f"r{i}", 4 if c == "*" else 0, c, 0 if c == "*" else 100 - i, 9, "*" if c == "*" else "4M", "*", 0, 0, "ACGT", "IIII", {"NH": "1"}) for i, c in enumerate(["chr10", "*", "chr2", "chr1", "chr2", "chr10", "*", "odd"])]
    df = spark.createDataFrame(rows, "qname string, flag int, chr string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>")
    places = [tuple(r) for r in tables.in_header_order(df, {"chr1": 9, "chr2": 9, "chr10": 9}).select("chr", "pos").collect()]
    assert places == [("chr1", 97), ("chr2", 96), ("chr2", 98), ("chr10", 95), ("chr10", 100), ("odd", 93), ("*", 0), ("*", 0)]
    paths = bam.write_bam(df.filter("chr != 'odd'"), str(tmp_path / "s"), {"chr1": 9, "chr2": 9, "chr10": 9}, by_place=True)
    assert [r[3] for p in paths for r in bam.records(p, 0, 1 << 62)] == ["chr1", "chr2", "chr2", "chr10", "chr10", "*", "*"]


def test_names_of_files_take_no_pattern(spark, tmp_path):
    (tmp_path / "l.sam").write_text("r\t0\tc\t1\t9\t1M\t*\t0\t0\tA\tI\n")
    got = tables.read_sam(spark, str(tmp_path / "l.sam"))
    assert got.first()["file"] == "l.sam"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "input_file_name" in plan and "regexp_extract(input_file_name" not in plan
