"""Mapping to files: read groups, edit distance, orientations of pairs, quality letters."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from readloom import api
from readloom.operators import align as A
from readloom.operators import second_pass as P
from readloom.operators.readtools import phred_33
from readloom.sources import bam

TURN = str.maketrans("ACGT", "TGCA")


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(TURN)


def spoiled(s):
    """A mismatch in each eight bases, so that no seed finds it."""
    return "".join("ACGT"["ACGT".index(c) ^ 1] if i % 8 == 6 else c for i, c in enumerate(s))


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    g = genome(5000, 1)
    g = g[:1038] + "ACGTCA" + g[1044:]  # so that GT is left out in one way only
    (d / "g.fa").write_text(f">c1\n{g}\n>c2\n{genome(2000, 2)}\n")
    reads = {"far": g[3000:3080], "near": g[300:380], "deleted": g[1000:1040] + g[1042:1082], "lost": "ACGT" * 20}
    (d / "r.fq").write_text("".join(f"@{n}\n{s}\n+\n{'h' * len(s)}\n" for n, s in reads.items()))
    (d / "two.fq").write_text("".join(f"@{n}\n{turned(s)}\n+\n{'h' * len(s)}\n" for n, s in {"far": g[3200:3280], "near": g[500:580], "deleted": g[1200:1280], "lost": g[4000:4080]}.items()))
    api.build_index(spark, str(d / "g.fa"), str(d / "ix"))
    return d


@pytest.mark.parametrize("form", ["bam", "sam"])
def test_single_ends_to_files(spark, place, form):
    target = str(place / f"out_{form}")
    (summary,) = api.align_to_files(spark, str(place / "ix"), str(place / "r.fq"), target, form=form, by_place=True, read_group="g1", group_fields=["SM:a"], kind="dna", phred=64).collect()
    assert (summary["total"], summary["mapped"], summary["unmapped"]) == (4, 3, 1)
    files = sorted(str(p) for p in (place / f"out_{form}").iterdir() if p.suffix == ("." + form if form == "bam" else ".txt"))
    got = [r for f in files for r in api.read_alignments(spark, f).collect()]
    want = {"near": ("c1", 301, "80M", "0"), "deleted": ("c1", 1001, "40M2D40M", "2"), "far": ("c1", 3001, "80M", "0"), "lost": ("*", 0, "*", None)}
    assert {r["qname"]: (r["chr"], r["pos"], r["cigar"], r["tags"].get("NM")) for r in got} == want
    assert all(r["rg"] == "g1" and r["qual"] == "I" * 80 for r in got)
    if form == "bam":
        text, contigs, _ = bam.read_header(files[0])
        assert "@RG\tID:g1\tSM:a" in text and contigs == [("c1", 5000), ("c2", 2000)]
        assert all((place / "out_bam" / (f.rpartition("/")[2] + ".bai")).exists() for f in files)


def test_pairs_to_files(spark, place):
    (summary,) = api.align_to_files(spark, str(place / "ix"), str(place / "r.fq"), str(place / "pairs"), mates=str(place / "two.fq"), read_group="g2", kind="dna").collect()
    assert (summary["total"], summary["properly_paired"], summary["unmapped"], summary["singleton"]) == (8, 6, 1, 1)
    got = [r for f in (place / "pairs").iterdir() if f.suffix == ".bam" for r in api.read_alignments(spark, str(f)).collect()]
    assert len(got) == 8 and {r["rg"] for r in got} == {"g2"}


def test_bad_arguments(spark, place):
    for bad in ({"form": "cram"}, {"group_fields": ["SM:a"]}, {"phred": 50}):
        with pytest.raises(ValueError):
            api.align_to_files(spark, str(place / "ix"), str(place / "r.fq"), str(place / "none"), **bad)


def test_quality_letters(spark):
    df = spark.createDataFrame([("@ABh~;?",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(phred_33(F.col("q"), 64)).collect()] == ["!\"#I_!!", "", None]
    assert [r[0] for r in df.select(phred_33(F.col("q"), 33)).collect()] == ["@ABh~;?", "", None]


@pytest.mark.parametrize("orientation", ["fr", "rf", "ff"])
def test_orientations(spark, orientation):
    g = genome(6000, 4)
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, 6000, 1000)], "chr string, start long, seq string")
    rows, want = [], {}
    for i in range(40):
        kind, a = ("fr", "rf", "ff")[i % 3], 100 + 120 * i
        left, right = g[a : a + 75], g[a + 225 : a + 300]
        one, two = {"fr": (left, turned(right)), "rf": (turned(left), right), "ff": (left, right)}[kind]
        if i % 2:  # from the fragment's other strand
            one, two = {"fr": (turned(right), left), "rf": (right, turned(left)), "ff": (turned(right), turned(left))}[kind]
        hard = i % 4  # no seed finds one of the ends, which are looked for beside the other
        one, two = (spoiled(one) if hard == 1 else one), (spoiled(two) if hard == 2 else two)
        rows.append((f"p{i}", one, two, "I" * 75))
        want[f"p{i}"] = kind == orientation
    df = spark.createDataFrame(rows, "rid string, one string, two string, qual string")
    index, o = A.build_index(chunks, chunk=1000).persist(), A.AlignOptions(best=4, orientation=orientation)
    first, second = (A.align(df.select("rid", F.col(c).alias("seq"), "qual"), index, chunks, o, 1000).persist() for c in ("one", "two"))
    got = {r["rid"]: r for r in P.rescue_mates(first, second, chunks, o, 1000).collect()}
    assert {n: r["proper"] for n, r in got.items()} == want
    assert all(abs(got[n]["tlen"]) == 300 for n, proper in want.items() if proper)
    with pytest.raises(ValueError):
        A.pair_up(first, second, replace(o, orientation="rr"))
