"""The functions by task, each at least once, on small files."""

from __future__ import annotations

import random
import re

import pytest

from readloom import api
from readloom.operators.counting import CountOptions
from readloom.operators.variants import SnpOptions
from readloom.sources import bam, tables

RNG = random.Random(21)
G = "".join(RNG.choice("ACGT") for _ in range(6000))
G = G[:2000] + "GT" + G[2002:2998] + "AG" + G[3000:]
GTF = """c1\ts\texon\t101\t600\t.\t+\t.\tgene_id "a"; transcript_id "t"; gene_name "Alpha";
c1\ts\texon\t1501\t2000\t.\t+\t.\tgene_id "b"; transcript_id "u"; gene_name "Beta";
c1\ts\texon\t3001\t3500\t.\t+\t.\tgene_id "b"; transcript_id "u"; gene_name "Beta";
"""


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "g.fa").write_text(f">c1\n{G}\n")
    (d / "a.gtf").write_text(GTF)
    api.build_index(spark, str(d / "g.fa"), str(d / "ix"))
    return d


def sam(d, name, rows, header="@SQ\tSN:c1\tLN:6000\n"):
    (d / name).parent.mkdir(exist_ok=True)
    (d / name).write_text(header + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(d / name)


def fastq(d, name, reads):
    (d / name).parent.mkdir(exist_ok=True)
    (d / name).write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    return str(d / name)


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def counts(out):
    return {r["key"]: {k: v for k, v in r.asDict().items() if k != "key"} for r in out["counts"].collect()}


def test_libraries_with_one_base_name_stay_apart(spark, place):
    row = ("r", 0, "c1", 150, 40, "50M", "*", 0, 0, G[149:199], "I" * 50, "NH:i:1", "RG:Z:g1")
    paths = [sam(place, "x/l.sam", [row]), sam(place, "y/l.sam", [row, ("s", *row[1:-1], "RG:Z:g2")])]
    out = api.feature_counts(spark, paths, str(place / "a.gtf"), is_gtf=True, extra=("gene_name",))
    assert counts(out) == {"a": {paths[0]: 1.0, paths[1]: 2.0}}
    assert {r["gene_id"]: r["gene_name"] for r in out["annotation"].collect()} == {"a": "Alpha", "b": "Beta"}
    assert [r["status"] for r in out["summary"].collect()][0] == "Assigned" and out["summary"].count() == 14
    assert counts(api.feature_counts(spark, paths[1], str(place / "a.gtf"), is_gtf=True, by_read_group=True)) == {"a": {"l.sam:g1": 1.0, "l.sam:g2": 1.0}}


def test_pairs_junctions_and_split_reads(spark, place):
    seq = G[1980:2000] + G[3000:3030]
    rows = [("p", 99, "c1", 1981, 40, "20M1000N30M", "=", 3051, 1120, seq, "I" * 50, "NH:i:1", "HI:i:1"), ("p", 147, "c1", 3051, 40, "50M", "=", 1981, -1120, G[3050:3100], "I" * 50, "NH:i:1", "HI:i:1")]
    path = sam(place, "p.sam", rows)
    out = api.feature_counts(spark, path, str(place / "a.gtf"), is_gtf=True, junction_counts=True, genome=str(place / "g.fa"), options=CountOptions(paired=True))
    assert counts(out) == {"b": {"p.sam": 1.0}}
    j = out["junctions"].collect()
    assert len(j) == 1 and out["junctions"].columns[:5] == ["GeneName", "TranscriptID", "Status", "nExons", "Dist.to.nearest.splicing.site"] and len(out["junctions"].columns) == 12
    assert tuple(j[0]) == ("b", "u", "KNOWN", 2, "0/0", "c1", 2000, "+", "c1", 3001, "+", 1)
    split = api.feature_counts(spark, path, str(place / "a.gtf"), is_gtf=True, options=CountOptions(paired=True, non_split_only=True))["summary"]
    assert {r["status"]: r["p.sam"] for r in split.collect() if r["p.sam"]} == {"Unassigned_Split": 1}
    with pytest.raises(ValueError):
        api.feature_counts(spark, path, str(place / "a.gtf"), is_gtf=True)


def test_insertions_count_as_length_and_contigs_end_extensions(spark, place):
    (place / "s.saf").write_text("GeneID\tChr\tStart\tEnd\tStrand\nx\tc1\t101\t140\t+\ny\tc1\t5990\t5995\t+\n")
    ins = ("i", 0, "c1", 101, 40, "20M20I20M", "*", 0, 0, "A" * 60, "I" * 60)
    last = ("e", 0, "c1", 5931, 40, "50M", "*", 0, 0, "A" * 50, "I" * 50)
    path = sam(place, "i.sam", [ins, last])
    status = lambda **o: {r["fid"].split("\x1f")[1]: r["status"] for r in api.feature_counts(spark, path, str(place / "s.saf"), options=CountOptions(**o))["assigned"].collect()}
    assert status(frac_overlap=0.9)["i"] == "Unassigned_Overlapping_Length" and status(frac_overlap=0.6)["i"] == "Assigned"
    assert status(extend_3=1000)["e"] == "Assigned" and status(shift=1000, shift_type="right", reduce_to=3)["e"] == "Unassigned_NoFeatures"


def test_mates_share_an_insertion_once(spark):
    from readloom.operators import counting as C

    def length(c1, p1, c2, p2, chr2="c"):
        r = lambda f, c, p, n: (1, f, n, p, 40, c, 0, 1)
        df = spark.createDataFrame([r(65, c1, p1, "c"), r(129, c2, p2, chr2)], "q int, flag int, chr string, pos int, mapq int, cigar string, tlen int, nh int")
        o = C.CountOptions(paired=True, frac_overlap=0.5, mate_orientation="ff")
        return C._sections(C.fragments_of(df, ["q"]), o, ()).first()["frag_length"]

    assert length("10M5I10M", 100, "10M5I10M", 100) == 25  # both have it
    assert length("10M5I10M", 100, "20M", 100) == 20  # one has it where both cover
    assert length("10M5I10M", 100, "20M", 200) == 45  # they don't overlap
    assert length("10M5I10M", 100, "10M3I10M", 100) == 20  # lengths differ
    assert length("10M5I10M", 100, "10M5I10M", 100, "d") == 50


def test_snps_with_indels_and_a_control(spark, place):
    def reads(name, base, k):
        rows = []
        for i in range(k):
            s = 900 + i % 40
            seq = list(G[s : s + 100])
            if i % 2:
                seq[1000 - s - 1] = base
            rows.append((f"r{i}", 0, "c1", s + 1, 40, "100M", "*", 0, 0, "".join(seq), "I" * 100))
            rows.append((f"d{i}", 0, "c1", 1201, 40, "30M2D30M", "*", 0, 0, G[1200:1230] + G[1232:1262], "I" * 60))
        return sam(place, name, rows)

    other = "A" if G[999] != "A" else "C"
    a, b = reads("t.sam", other, 60), reads("n.sam", G[999], 60)
    got = api.exact_snp(spark, a, str(place / "g.fa"), options=SnpOptions(), control=b).collect()
    snp = [r for r in got if not r["info"].startswith("INDEL")]
    assert [(r["pos"], r["ref"], r["alt"]) for r in snp] == [(1000, G[999], other)] and "CTRL_DP=54;CTRL_MM=0;VS_QV=" in snp[0]["info"]
    indel = [r for r in got if r["info"].startswith("INDEL")]
    assert [(r["pos"], r["ref"], r["alt"], r["info"]) for r in indel] == [(1230, G[1229:1232], G[1229], "INDEL;DP=60;SR=60")]


def test_mapping_of_pairs_spliced_and_long_reads(spark, place):
    a = fastq(place, "m1.fastq", [("p/1", G[300:375]), ("q/1", G[1960:2000] + G[3000:3040])])
    b = fastq(place, "m2.fastq", [("p/2", turned(G[425:500])), ("q/2", turned(G[3100:3175]))])
    got = {(r["qname"], r["flag"]): r for r in api.align(spark, str(place / "ix"), a, b).collect()}
    one, two = got["p", 99], got["p", 147]
    assert (one["pos"], one["pnext"], one["tlen"], one["rnext"]) == (301, 426, 200, "=") and (two["pos"], two["pnext"], two["tlen"]) == (426, 301, -200) and one["tags"]["NM"] == "0"
    assert {r["rid"]: r["cigar"] for r in api.subjunc(spark, str(place / "ix"), a).collect()} == {"p": "75M", "q": "40M1000N40M"}
    reads = [("x", G[500:2500]), ("y", turned("TTTTT" + G[700:1200] + "ACG" + G[1200:1700] + G[1704:2400]))]
    long = {r["rid"]: (r["flag"], r["pos"], r["cigar"], r["nm"]) for r in api.sublong(spark, str(place / "ix"), fastq(place, "long.fastq", reads)).collect()}
    assert long["x"] == (0, 501, "2000M", 0)
    flag, pos, cigar, nm = long["y"]
    kinds = {op: sum(int(k) for k, o in re.findall(r"(\d+)([A-Z])", cigar) if o == op) for op in "MIDS"}
    assert flag == 16 and abs(pos - 701) <= 16 and kinds["I"] - kinds["D"] == 3 - 4 and nm == kinds["I"] + kinds["D"] and kinds["M"] + kinds["I"] + kinds["S"] == len(reads[1][1])


def test_structural_variants_of_pairs(spark, place):
    a = fastq(place, "v1.fastq", [(f"d{i}/1", G[100 + i : 175 + i]) for i in range(3)] + [(f"v{i}/1", G[3200 + i : 3275 + i]) for i in range(3)])
    b = fastq(place, "v2.fastq", [(f"d{i}/2", turned(G[4000 + i : 4075 + i])) for i in range(3)] + [(f"v{i}/2", G[3500 + i : 3575 + i]) for i in range(3)])
    got = sorted((r["kind"], r["pos1"], r["end1"], r["pos2"], r["end2"], r["support"]) for r in api.structural_variants(spark, str(place / "ix"), a, b).collect())
    assert got == [("deletion", 101, 103, 4001, 4003, 3), ("inversion", 3201, 3203, 3501, 3503, 3)]


@pytest.mark.parametrize("mode", ["fastq", "fastq-dir", "bam"])
def test_cell_counts(spark, place, mode):
    codes = ["".join(RNG.choice("ACGT") for _ in range(16)) for _ in range(3)]
    reads = []
    for i in range(90):
        start = 120 + i if i % 3 else 3010 + i
        reads.append((f"n{i}", codes[i % 2] + "".join(RNG.choice("ACGT") for _ in range(12)), G[start : start + 70]))
    first, second = [(n, bc) for n, bc, _ in reads], [(n, s) for n, _, s in reads]
    if mode == "fastq":
        sheet = spark.createDataFrame([(fastq(place, "c1.fastq", first), fastq(place, "c2.fastq", second), "s")], "BarcodeUMIFile string, ReadFile string, SampleName string")
    elif mode == "fastq-dir":
        for lane in (1, 2):
            fastq(place, f"lanes/s_L00{lane}_R1_001.fastq", first[lane - 1 :: 2])
            fastq(place, f"lanes/s_L00{lane}_R2_001.fastq", second[lane - 1 :: 2])
        sheet = spark.createDataFrame([(str(place / "lanes"), "s")], "FastqDirectory string, SampleName string")
    else:
        rows = [(n, 16 if i % 2 else 4, "c1" if i % 2 else "*", 1 if i % 2 else 0, 0, "70M" if i % 2 else "*", "*", 0, 0, turned(s) if i % 2 else s, "I" * 70, f"CR:Z:{bc[:16]}", f"UR:Z:{bc[16:]}") for i, (n, bc, s) in enumerate(reads)]
        made = bam.write_bam(tables.read_sam(spark, sam(place, "cells.sam", rows)), str(place / "cells"), {"c1": 6000})
        sheet = spark.createDataFrame([(str(place / "cells"), "s")] if len(made) == 1 else [(p, "s") for p in made], "BAMFile string, SampleName string")
    known = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "barcode string, ordinal long")
    out = api.cell_counts(spark, str(place / "ix"), sheet, known, str(place / "a.gtf"), cutoff=1, is_gtf=True)
    got = {(r["cell"], r["gene"]): r["umis"] for r in out["counts"].collect()}
    want = {}
    for i in range(90):
        key = codes[i % 2], "a" if i % 3 else "b"
        want[key] = want.get(key, 0) + 1
    assert got == want and out["samples"].first()["total_cells"] == 2


def test_other_tasks(spark, place):
    r = lambda n, f, p: (n, f, "c1", p, 40, "50M", "=", p, 0, G[p - 1 : p + 49], "I" * 50)
    path = sam(place, "o.sam", [r("a", 65, 150), r("a", 129, 150), r("b", 65, 400), r("c", 0, 150)])
    assert api.repair(spark, path).filter("dummy").count() == 2 and "seq" not in api.repair(spark, path, full_data=False).columns
    assert api.remove_dup_reads(spark, path, 3).count() == 1 and api.propmapped(spark, path).first()["num_total"] == 3
    assert api.sam2bed(spark, path).count() == 4
    assert sorted(x["ordinal"] for x in api.quality_scores(spark, path, 100).collect()) == [0, 1, 2, 3]
    assert sorted(x["ordinal"] for x in api.quality_scores(spark, fastq(place, "o.fastq", [(f"q{i}", "ACGT" * 5) for i in range(7)]), 100).collect()) == list(range(7))
    both = api.detection_call_annotation(spark, str(place / "a.gtf"), str(place / "g.fa"), 200)
    exons = {(x["start"], x["gc"]) for x in both["exons"].collect()}
    assert exons == {(s, sum(c in "GC" for c in G[s - 1 : e])) for s, e in ((101, 600), (1501, 2000), (3001, 3500))}
    called = api.detection_call(spark, path, both["exons"], both["bins"]).collect()
    assert {x["gene_id"]: x["reads"] for x in called} == {"a": 4, "b": 0} and all(0 <= x["p_value"] <= 1 for x in called)
    sim = api.sim_reads(spark, str(place / "g.fa"), spark.createDataFrame([("c1", 1.0)], "transcript_id string, expression double"), 20)
    assert sim.count() == 20
    assert api.promoter_regions(spark, spark.createDataFrame([("x", "c1", 101, 140, "+")], "GeneID string, Chr string, Start int, End int, Strand string")).count() == 1
    with pytest.raises(ValueError):
        (place / "twice.fa").write_text(">c1\nACGT\n>c1\nACGT\n")
        api.build_index(spark, str(place / "twice.fa"), str(place / "bad"))
    with pytest.raises(ValueError):
        (place / "empty.fa").write_text(">c1\n>c2\nACGT\n")
        api.build_index(spark, str(place / "empty.fa"), str(place / "bad2"))
