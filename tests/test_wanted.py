"""Indexes built with the 16-mers alone that seeds ask for."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import align as A
from readloom.operators.simulate import simulate_reads
from readloom.operators.wanted import Wanted, narrowed


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(11)
    contigs = ["".join(rng.choices("ACGT", k=20_000)) for _ in range(4)]
    chunks = [(f"c{i}", s + 1, g[s : s + 1300]) for i, g in enumerate(contigs) for s in range(0, len(g), 1000)]
    reads = [(f"{i}:{at}", contigs[i][at : at + 75], "I" * 75) for i in range(4) for at in range(0, 19_000, 6_000)]
    return spark.createDataFrame(chunks, "chr string, start long, seq string"), spark.createDataFrame(reads, "rid string, seq string, qual string")


def test_few_places_pass_and_none_is_lost(genome):
    chunks, reads = genome
    seeds, index = A.seeds(reads), A.build_index(chunks, chunk=1000)
    some = narrowed(index, seeds)
    met = lambda ix: sorted(map(tuple, seeds.join(ix, "kmer").select("rid", "strand", "offset", "chr", "pos").collect()))
    assert met(some) == met(index) and met(some)
    # a shuffle of the whole index had 79,940 rows
    assert some.count() < 3_000 < index.count()


@pytest.mark.parametrize("log2", [16, 30])
def test_a_full_filter_loses_none(spark, log2):
    ids = spark.range(200_000).select((F.col("id") * 7919).alias("kmer"))
    wanted = Wanted(ids, log2)
    kmers = ids.toPandas()["kmer"].to_numpy()
    assert wanted(kmers).all() and (log2 == 16 or wanted(kmers + 1).mean() < 0.05)


def test_reads_are_mapped_as_with_the_whole_index(genome):
    chunks, reads = genome
    index = A.build_index(chunks, chunk=1000)
    whole = index.select("*")  # not to be narrowed
    got, want = (sorted(map(str, A.align(reads, ix, chunks, A.AlignOptions(), 1000).collect())) for ix in (index, whole))
    assert got == want and sum("chr='c" in x for x in got) == reads.count()


def test_a_transcript_is_dealt_out_with_blocks_of_its_reads(spark):
    """Of a thousand reads of one transcript, its bases went a thousand times through the shuffle."""
    seq = "".join(random.Random(3).choices("ACGT", k=2000))
    made = simulate_reads(spark.createDataFrame([("t", seq, 1.0)], "transcript_id string, seq string, expression double"), 1000, 75)
    rows = made.collect()
    assert sorted(int(r["name"].split("_")[1]) for r in rows) == list(range(1, 1001))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(x for x in plan.splitlines() if "RepartitionByExpression" in x)
    assert "block" in dealt
