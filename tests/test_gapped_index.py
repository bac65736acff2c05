"""Reads map on an index of one place in three."""

from __future__ import annotations

import random

import pytest

from readloom import api


@pytest.mark.parametrize("stored", [True, False])
def test_reads_map_on_a_gapped_index(spark, tmp_path, stored):
    rng = random.Random(5)
    g = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "g.fa").write_text(f">c1\n{g}\n")
    reads = [(n, s) for n in (70, 125, 151) for s in range(100, 130)]
    (tmp_path / "r.fastq").write_text("".join(f"@{n}_{s}\n{g[s : s + n]}\n+\n{'I' * n}\n" for n, s in reads))
    api.build_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "ix"), gapped=True)
    if not stored:
        (tmp_path / "ix/step").rename(tmp_path / "aside")
    got = {r["rid"]: r["pos"] for r in api.align(spark, str(tmp_path / "ix"), str(tmp_path / "r.fastq")).collect()}
    assert got == {f"{n}_{s}": s + 1 for n, s in reads}
