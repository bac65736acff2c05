"""Reads of DNA whose unmethylated C bisulfite has turned."""

from __future__ import annotations

import random

import numpy as np
import pytest

from readloom import api
from readloom.operators import align as A
from readloom.operators import local as L

TURN = str.maketrans("ACGT", "TGCA")


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(TURN)


def test_bases_that_match():
    read, ref = (np.frombuffer(x, np.uint8) for x in (b"CTGAGATCT", b"ccccgggAT"))
    assert L.same_or_converted(read, ref).tolist() == [True, True, False, False, True, True, False, False, True]
    assert L.base_scores(read, ref, L.same_or_converted).tolist() == [1, 1, -4, -4, 1, 1, -4, -4, 1]


def test_converted_ends_map(spark):
    g = genome(6000, 3)
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, 6000, 1000)], "chr string, start long, seq string")
    index, rng, rows, want = A.build_converted_index(chunks, chunk=1000).persist(), random.Random(5), [], {}
    for i in range(60):
        a = rng.randrange(5800)
        part = g[a : a + 100]
        part = part if i % 2 == 0 else turned(part)
        some = "".join("T" if c == "C" and rng.random() < 0.8 else c for c in part)  # four of five C are turned
        if i % 6 == 4:  # three bases left out
            some = some[:50] + some[53:]
        rows.append((f"r{i}", some, "I" * len(some)))
        want[f"r{i}"] = (16 * (i % 2), a + 1, 0, i % 6 == 4)
    first = spark.createDataFrame(rows, "rid string, seq string, qual string")
    second = spark.createDataFrame([(n, turned(s), q) for n, s, q in rows], "rid string, seq string, qual string")
    for reads, o, flip in ((first, A.AlignOptions(converted="CT"), 0), (second, A.AlignOptions(converted="GA"), 16)):
        got = {r["rid"]: (r["flag"] ^ flip, r["pos"], r["nm"], "D" in r["cigar"]) for r in A.align(reads, index, chunks, o, 1000).collect()}
        assert got == want
    # taken for plain reads, they don't map: their seeds differ from the reference
    plain = A.align(first, A.build_index(chunks, chunk=1000), chunks, A.AlignOptions(), 1000)
    assert plain.filter("chr != '*' AND nm = 0 AND cigar = '100M'").count() <= 2
    # a C where the reference has T can't come from bisulfite
    wrong = g[1000:1100].replace("C", "T")
    wrong = wrong[:40] + ("A" if g[1040] == "C" else "C") + wrong[41:]
    one = spark.createDataFrame([("w", wrong, "I" * 100), ("none", None, None), ("short", "ACG", "III")], "rid string, seq string, qual string")
    assert [(r["pos"], r["nm"]) for r in A.align(one, index, chunks, A.AlignOptions(converted="CT"), 1000).filter("rid = 'w'").collect()] == [(1001, 1)]
    for bad in (A.AlignOptions(converted="AC"), A.AlignOptions(converted="CT", junctions=True)):
        with pytest.raises(ValueError):
            A.align(one, index, chunks, bad, 1000)


def test_files_of_converted_pairs(spark, tmp_path):
    g = genome(5000, 9)
    (tmp_path / "g.fa").write_text(">c1\n" + g + "\n")
    api.build_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "ix"), converted=True)
    with open(tmp_path / "r1.fq", "w") as one, open(tmp_path / "r2.fq", "w") as two:
        for i in range(20):
            part = g[200 * i : 200 * i + 300]
            part = (part if i % 2 == 0 else turned(part)).replace("C", "T")
            one.write(f"@p{i}/1\n{part[:80]}\n+\n{'I' * 80}\n")
            two.write(f"@p{i}/2\n{turned(part)[:80]}\n+\n{'I' * 80}\n")
    got = api.align(spark, str(tmp_path / "ix"), str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq"), kind="dna").collect()
    assert len(got) == 40 and all(r["flag"] & 2 and r["tags"]["NM"] == "0" and abs(r["tlen"]) == 300 for r in got)
    assert {(r["qname"], r["pos"]) for r in got if r["flag"] & 64} == {(f"p{i}", 200 * i + (1 if i % 2 == 0 else 221)) for i in range(20)}
    single = api.align(spark, str(tmp_path / "ix"), str(tmp_path / "r1.fq"), kind="dna").collect()
    assert len(single) == 20 and all(r["nm"] == 0 and r["cigar"] == "80M" for r in single)
    with pytest.raises(ValueError):
        api.subjunc(spark, str(tmp_path / "ix"), str(tmp_path / "r1.fq"))
