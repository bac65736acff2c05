"""Local reassembly: paths of k-mers, planted insertions, odd rows."""

from __future__ import annotations

import random

from readloom import api
from readloom.operators import align as A
from readloom.operators.reassembly import _trimmed, bubbles, reassemble


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def kmers(s, k, n=3):
    return {s[i : i + k]: n for i in range(len(s) - k + 1)}


def test_bubbles():
    ref, new = genome(220, 1), genome(90, 2)
    other = ref[:110] + new + ref[110:]
    [(at, old, alt, n)] = bubbles(kmers(other[60:260], 21), ref, 21, 300)
    assert n == 3 and old == ref[at] == alt[0] and ref[: at + 1] + alt[1:] + ref[at + 1 :] == other
    assert bubbles(kmers(other[60:260], 21), ref, 21, 30) == []  # longer than is looked for
    assert bubbles(kmers(ref, 21), ref, 21, 300) == [] == bubbles({}, ref, 21, 300) == bubbles({}, "", 21, 300)
    twice = ref[:130] + ref[90:130] + ref[130:]  # a tandem copy goes back on the reference
    [(at, old, alt, n)] = [x for x in bubbles(kmers(twice, 21), ref, 21, 300) if len(x[2]) > len(x[1])]
    assert ref[:at] + alt + ref[at + len(old) :] == twice
    assert _trimmed(5, "ACCG", "ACCCCG") == (5, "A", "ACC")


def test_planted_insertions_are_called(spark):
    g = genome(6000, 3)
    sizes, shift, alt = {1000: 30, 2000: 80, 3000: 150, 4500: 6}, 0, g
    for at, n in sorted(sizes.items(), reverse=True):
        alt = alt[:at] + genome(n, at) + alt[at:]
    pairs = [(f"p{s}", alt[s : s + 100], turned(alt[s + 200 : s + 300])) for s in range(0, len(alt) - 300, 7)]
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, 6000, 1000)], "chr string, start long, seq string")
    index = A.build_index(chunks, chunk=1000)
    one = lambda no: A.align(spark.createDataFrame([(p[0], p[no], "I" * 100) for p in pairs], "rid string, seq string, qual string"), index, chunks, A.AlignOptions(best=4), 1000)
    records = A.mate_records(A.pair_up(one(1), one(2))).cache()
    got = {r["pos"]: r for r in reassemble(records, chunks, 1000).collect()}
    want = {}
    for at, n in sizes.items():
        old, new = g[at - 200 : at + 200], g[at - 200 : at] + genome(n, at) + g[at : at + 200]
        offset, ref, other = _trimmed(at - 200 + 1, old, new)
        want[offset] = (ref, other)
    assert {p: (r["ref"], r["alt"]) for p, r in got.items()} == want
    assert all(r["support"] >= 2 for r in got.values())
    again = records.unionByName(records).unionByName(records)  # repeated rows change counts only
    assert {(r["pos"], r["alt"]) for r in reassemble(again, chunks, 1000, support=4).collect()} >= {(p, a) for p, (_, a) in want.items()}
    plain = spark.createDataFrame([(0, "c1", 10, "100M", g[9:109]), (4, "*", 0, "*", "ACGT"), (0, "c1", 5, None, None), (4, "c1", 5, "*", "N" * 60), (None, "c1", 5, "5S20M", "ACGTN" * 5)], "flag int, chr string, pos int, cigar string, seq string")
    assert reassemble(plain, chunks, 1000).count() == 0 == reassemble(records.limit(0), chunks, 1000).count()


def test_insertions_of_single_ends(spark, tmp_path):
    g, new = genome(3000, 6), genome(60, 7)
    alt = g[:1500] + new + g[1500:]
    (tmp_path / "g.fa").write_text(f">c1\n{g}\n")
    (tmp_path / "r.fastq").write_text("".join(f"@r{s}\n{alt[s : s + 100]}\n+\n{'I' * 100}\n" for s in range(1350, 1650, 4)))
    api.build_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "ix"))
    [r] = api.insertions(spark, str(tmp_path / "ix"), str(tmp_path / "r.fastq")).collect()
    assert r["chr"] == "c1" and g[: r["pos"] - 1] + r["alt"] + g[r["pos"] :] == alt
