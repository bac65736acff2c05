from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def tables(spark, folder):
    rng = random.Random(3)
    vocabulary = ["river", "walks", "under", "bright", "moon", "sings", "softly", "today", "stone", "garden"]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(rng.randrange(30, 80))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "grobnak"]))
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[1][1], "en", "s1", 0) for i in range(5)] + [(2000, rows[2][1] + " more", "en", None, 0), (3000, None, None, None, None), (3001, "", "en", "s0", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_each_stage_works_on_what_the_last_kept(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    clean, toxic = {r[0] for r in rows if "grobn" not in (r[1] or "")}, {r[0] for r in rows if "grobn" in (r[1] or "")}
    assert not toxic & set(kept["toxicity"]) and len(clean - set(kept["toxicity"])) <= 2
    assert len(kept["exact_dedup"]) == len({r[1] or "" for r in rows if r[0] in set(kept["toxicity"])})
    assert {1004, 3001} <= set(kept["exact_dedup"]) and not {1, 1000, 3000} & set(kept["exact_dedup"])
    assert set(kept["near_dedup"]) <= set(kept["exact_dedup"]) and len(kept["near_dedup"]) == len(set(kept["near_dedup"]))
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(kept["mixing"].count(i) for i in set(kept["mixing"])) == 2
    assert sorted(kept["packing"]) == sorted(kept["mixing"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.filter(F.col("piece") > 0).count() == 0
