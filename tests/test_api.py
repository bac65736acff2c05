from __future__ import annotations

import random

from readloom import api


def test_from_index_to_counts(spark, tmp_path):
    rng = random.Random(8)
    g = "".join(rng.choice("ACGT") for _ in range(4000))
    (tmp_path / "g.fa").write_text(f">c1\n{g}\n")
    (tmp_path / "a.gtf").write_text('c1\ts\texon\t101\t600\t.\t+\t.\tgene_id "a"; transcript_id "t";\nc1\ts\texon\t2001\t2500\t.\t+\t.\tgene_id "b"; transcript_id "u";\n')
    starts = [100, 150, 200, 2100, 3000]
    (tmp_path / "r.fastq").write_text("".join(f"@r{i}\n{g[s:s + 80]}\n+\n{'I' * 80}\n" for i, s in enumerate(starts)))
    api.build_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "ix"))
    got = api.align(spark, str(tmp_path / "ix"), str(tmp_path / "r.fastq"))
    assert sorted(r["pos"] for r in got.collect()) == [s + 1 for s in starts]
    from pyspark.sql import functions as F

    from readloom.sources import tables

    cols = got.withColumn("qname", F.col("rid")).withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "tags": F.create_map(F.lit("NH"), F.col("nh").cast("string"))})
    tables.write_sam(cols, str(tmp_path / "out"), {"c1": 4000})
    out = api.feature_counts(spark, [str(p) for p in (tmp_path / "out").glob("part-*") if p.stat().st_size], str(tmp_path / "a.gtf"), is_gtf=True)
    total = {}
    for r in out["counts"].collect():
        total[r["key"]] = sum(v for k, v in r.asDict().items() if k != "key")
    assert total == {"a": 3.0, "b": 1.0}
    assert {r["gene_id"]: r["length"] for r in out["annotation"].collect()} == {"a": 500, "b": 500}
    assert api.scan_fasta(spark, str(tmp_path / "g.fa")).first()["length"] == 4000
    assert api.atgc_content(spark, str(tmp_path / "r.fastq")).count() == 1
    assert len(api.quality_scores(spark, str(tmp_path / "r.fastq"), 3).collect()) <= 4
    assert [r["start"] for r in api.flatten_gtf(spark, str(tmp_path / "a.gtf")).collect()] == [101, 2001]
    assert api.tx_unique(spark, str(tmp_path / "a.gtf")).count() == 2
