"""Stretches without G must not make seeds of many contigs alike: a seed with more than 100 places is left out."""

from collections import Counter

import pytest

from readloom.plans import mapping_queries as M


class _Stop(Exception):
    pass


def test_16_bases_of_a_stretch_are_rare(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    kept = []

    def chunks(whole, *rest):  # the contigs are all that is looked at
        kept.append(whole)
        raise _Stop

    monkeypatch.setattr(M.views, "chunks", chunks)
    with pytest.raises(_Stop):
        M.clipped_reads_in_place(spark, str(tmp_path))
    seqs = [r["seq"] for r in kept[0].select("seq").collect()]
    counts = Counter(s[a + i : a + i + 16] for s in seqs for a in (294, 364) for i in range(27))
    assert len(seqs) == 20_000 and all(len(s) == 2560 and "G" not in s[294:336] + s[364:406] for s in seqs)
    assert max(counts.values()) <= 6  # where half of the bases are A, 16 of them stand at one place in 65,536
