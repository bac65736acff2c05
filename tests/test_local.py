"""Local alignment of batches against one read and one cell at a time."""

from __future__ import annotations

import random
import re

import numpy as np

from readloom.operators import align as A
from readloom.operators import local as L


def genome(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_best_stretch_equals_all_stretches():
    rng = np.random.default_rng(1)
    scores = np.where(rng.random((200, 30)) < 0.7, L.MATCH, L.MISMATCH).astype(np.int32)
    begin, end, best = L.best_stretch(scores)
    for row, a, b, s in zip(scores, begin, end, best):
        value = lambda a, b: row[a:b].sum() + L.CLIP * (int(a > 0) + int(b < 30))
        assert s == value(a, b) == max(value(i, j) for i in range(30) for j in range(i + 1, 31))


def slow_gapped(read, window, band):
    """The best score of a local alignment with affine gaps, cell by cell."""
    n, low, score, best = len(read), -(10**9), {}, 0
    for i in range(n + 1):
        for j in range(i, i + 2 * band + 1):
            up, left, before = score.get((i - 1, j), (low,) * 3), score.get((i, j - 1), (low,) * 3), score.get((i - 1, j - 1), (low,) * 3)
            m = max(0, *before) + (L.MATCH if read[i - 1] == window[j - 1] else L.MISMATCH) if i and j else low
            score[i, j] = (m, max(up[0] + L.OPEN + L.EXTEND, up[1] + L.EXTEND), max(left[0] + L.OPEN + L.EXTEND, left[2] + L.EXTEND) if i else low)
            best = max(best, m)
    return best


def planted(n, band, count):
    """Windows, and reads with insertions, deletions, mismatches and foreign ends."""
    rng, windows, reads = random.Random(7), [genome(n + 2 * band, i) for i in range(count)], []
    for w in windows:
        r = list(w[band:])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(5, n - 5)
            r[k : k + rng.randrange(3)] = rng.choice(["", "A", "GT", "C"])
        if rng.random() < 0.4:
            r[: rng.randrange(12)] = genome(rng.randrange(12), rng.random())
        reads.append(("".join(r) + genome(n, 99))[:n])
    return windows, reads


def test_gapped_equals_cell_by_cell():
    band, n = 4, 40
    windows, reads = planted(n, band, 60)
    best, place, ops, _ = L.gapped(A._matrix(reads, n), A._matrix(windows, n + 2 * band), band)
    for read, window, b, j, row in zip(reads, windows, best, place, ops):
        assert b == slow_gapped(read, window, band)
        row, i, value, last = row[row >= 0], 0, 0, 0
        for op in row.tolist():
            if op == 0:
                value += L.MATCH if read[i] == window[j] else L.MISMATCH
            elif op < 3:
                value += L.EXTEND + (L.OPEN if op != last else 0)
            i, j, last = i + (op != 2), j + (op in (0, 2)), op
        assert (i, value) == (n, b)


def test_alignments_account_for_the_read():
    band, n = 5, 80
    windows, reads = planted(n, band, 200)
    codes, refs = A._matrix(reads, n), A._matrix(windows, n + 2 * band)
    found = L.align_locally(codes, refs, band, band, 4, 24)
    assert len(found) > 120
    for r, place, cigar, wrong, score in found:
        i, j, bad, value = 0, place, 0, 0
        parts = re.findall(r"(\d+)([MIDS])", cigar)
        for at, (k, op) in enumerate(parts):
            k = int(k)
            if op == "M":
                miss = sum(a != b for a, b in zip(reads[r][i : i + k], windows[r][j : j + k]))
                bad, value = bad + miss, value + (k - miss) * L.MATCH + miss * L.MISMATCH
            elif op == "S":
                assert at in (0, len(parts) - 1)
                value += L.CLIP
            else:
                value += L.OPEN + k * L.EXTEND
            i, j = i + k * (op != "D"), j + k * (op in "MD")
        assert (i, bad, value) == (n, wrong, score) and bad <= 4
        assert parts[0][1] in "MS" and parts[-1][1] in "MS"


def test_reads_over_the_ends_of_a_contig():
    window = "\0" * 8 + genome(40, 1)
    read = "ACGTACGTAC"[:6] + window[8:42]
    ((_, place, cigar, wrong, _),) = L.align_locally(A._matrix([read], 40), A._matrix([window], 44), 2, 2, 3, 24)
    assert (place, cigar, wrong) == (8, "6S34M", 0)


def test_foreign_ends_and_long_deletions_map(spark):
    g = genome(6000, 5)
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, 6000, 1000)], "chr string, start long, seq string")
    rng, rows = random.Random(4), []
    for i in range(100):
        a = rng.randrange(5800)
        rows += [(f"h{i}", a + 13, genome(12, i) + g[a + 12 : a + 100]), (f"t{i}", a + 1, g[a : a + 80] + genome(20, i)), (f"d{i}", a + 1, g[a : a + 50] + g[a + 58 : a + 108])]
    df = spark.createDataFrame([(n, s, "I" * len(s)) for n, _, s in rows], "rid string, seq string, qual string")
    got = {r["rid"]: r for r in A.align(df, A.build_index(chunks, chunk=1000), chunks, A.AlignOptions(), 1000).filter("hi = 1").collect()}
    for kind, near in (("h", 4), ("t", 0), ("d", 62)):
        assert sum(n in got and abs(got[n]["pos"] - p) <= near for n, p, _ in rows if n[0] == kind) >= 95
    assert sum("S" in got[n]["cigar"] and not re.search("[ID]", got[n]["cigar"]) for n, _, _ in rows if n in got and n[0] != "d") >= 190
