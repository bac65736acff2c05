"""What the steps from seeds to votes leave on disk, and seeds of odd reads."""

import random
import time

import pytest

from readloom.operators import align as A
from readloom.operators import long_reads as L
from readloom.operators.wanted import meeting
from readloom.session import FREED, written


def _shuffled(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().endswith(".data") for i in range(files.size()))


def test_what_was_shuffled_for_a_written_table_goes(spark):
    before, setting = _shuffled(spark), spark.conf.get(FREED, None)
    out = written(spark.range(10_000).repartition(4, "id").groupBy("id").count(), "t")
    deadline = time.time() + 10
    while _shuffled(spark) > before and time.time() < deadline:
        time.sleep(0.2)
    assert _shuffled(spark) <= before and out.count() == 10_000 and spark.conf.get(FREED, None) == setting


def _genome(spark):
    rng = random.Random(5)
    whole = "".join(rng.choices("ACGT", k=8000))
    chunks = spark.createDataFrame([("c", s + 1, whole[s : s + 1300]) for s in range(0, 8000, 1000)], "chr string, start long, seq string")
    return whole, chunks


def test_seeds_of_the_wrong_strand_are_left_out(spark):
    whole, chunks = _genome(spark)
    reads = spark.createDataFrame([(str(a), whole[a : a + 100]) for a in range(0, 7800, 100)], "rid string, seq string")
    found = A.seeds(reads)
    some, index = meeting(found, A.build_index(chunks, chunk=1000))
    n = found.count()
    assert n == 78 * 20 and n / 2 <= some.count() < 0.6 * n
    join = lambda s: sorted(map(tuple, s.join(index, "kmer").select("rid", "strand", "offset", "chr", "pos").collect()))
    assert join(some) == join(found)


@pytest.mark.parametrize("step", [1, 3])
def test_seeds_of_odd_reads(spark, step):
    reads = [("low", "acgtacgtacgtacgtacgta"), ("n", "ACGTNCGTACGTTTTTACGTACGTAA"), ("short", "ACGTACGTACGTACG"), ("none", None), ("other", "ÄCGTACGTACGTACGTACGTTT"), ("equal", "A" * 16)]
    want = set()
    for rid, s in reads:
        s = (s or "").upper()
        for strand, t in (("+", s), ("-", s.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            last = len(t) - 16
            gap = max(last / 9, float(step))
            for a in {int(i * gap) + d for i in range(10) for d in range(step)}:
                if 0 <= a <= last and not set(t[a : a + 16]) - set("ACGT"):
                    want.add((rid, strand, a, int(t[a : a + 16].translate(str.maketrans("ACGT", "0123")))))
    got = [tuple(r) for r in A.seeds(spark.createDataFrame(reads, "rid string, seq string"), step=step).select("rid", "strand", "offset", "kmer").collect()]
    assert len(got) == len(want) and set(got) == want


def test_reads_of_one_name_are_mapped_each(spark):
    whole, chunks = _genome(spark)
    reads = spark.createDataFrame([("r", whole[100:200], "I" * 100), ("r", whole[2100:2200], "I" * 100)], "rid string, seq string, qual string")
    got = A.align(reads, A.build_index(chunks, chunk=1000), chunks, A.AlignOptions(), 1000).collect()
    assert sorted((r["rid"], r["pos"], r["nh"]) for r in got) == [("r", 101, 1), ("r", 2101, 1)]
    long = spark.createDataFrame([(7, whole[500:2500])], "rid int, seq string")
    assert [tuple(r) for r in L.align_long(long, A.build_index(chunks, chunk=1000)).select("rid", "start", "end").collect()] == [(7, 501, 2500)]


def test_contigs_are_dealt_out(spark, tmp_path):
    """The k-mers of all contigs were one task's work where the documents lie in one piece."""
    from readloom.plans.queries import _chunks

    spark.range(100).selectExpr("id AS doc_id", "'text' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    chunks = _chunks(spark, str(tmp_path))
    rows = chunks.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(rows) == 300 and max(rows) < 200
