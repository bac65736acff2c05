"""Words of converted references, and indexes whose bases stay where they are read."""

from __future__ import annotations

import os
import random

from readloom.operators import align as A
from readloom.operators.wanted import Wanted
from readloom.plans import views
from readloom.session import written


def test_converted_words_tell_places_apart_where_16_bases_do_not(spark):
    """One base in four tells places apart: each 16-mer has some 25 places, each word of 24 bases three."""
    rng = random.Random(7)
    g = "".join("AGT" + rng.choice("AGT") for _ in range(2000))
    chunks = spark.createDataFrame([("c1", a + 1, g[a : a + 1300]) for a in range(0, len(g), 1000)], "chr string, start long, seq string")
    at = [rng.randrange(len(g) - 100) for _ in range(40)]
    reads = spark.createDataFrame([(f"r{a}", g[a : a + 100], "I" * 100) for a in at], "rid string, seq string, qual string")
    index = A.build_converted_index(chunks, max_occurrences=10, chunk=1000)
    got = {(r["rid"], r["pos"], r["cigar"]) for r in A.align(reads, index, chunks, A.AlignOptions(converted="CT"), 1000).collect()}
    assert got == {(f"r{a}", a + 1, "100M") for a in at}


def test_bases_of_an_index_do_not_shuffle(spark):
    rng = random.Random(5)
    contigs = spark.createDataFrame([(f"c{n}", "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=n))) for n in (5, 990, 1000, 1001, 1300, 2560)], "chr string, seq string")
    chunks = views.chunks(contigs, 1000, 300)
    places = lambda index: sorted(map(tuple, index.collect()))
    index, plain = A.build_index(chunks, chunk=1000), A.build_index(chunks.drop("last"), chunk=1000)
    assert places(index) == places(plain) and places(index)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan(plain) and "Join" not in plan(index)


def test_the_seeds_16_mers_go_when_their_filter_is_built(spark, monkeypatch):
    from readloom.operators import wanted

    kept = []
    monkeypatch.setattr(wanted, "written", lambda df, name, write=wanted.written: kept.append(write(df, name)) or kept[-1])
    Wanted(spark.range(1000).withColumnRenamed("id", "kmer"))
    assert kept and not any(os.path.exists(t.written_at.removeprefix("file://")) for t in kept)


def test_seeds_are_never_broadcast(spark):
    """A read of 100 bases has 20 seeds, a long one thousands, but Spark's guess of their size is that of the reads."""
    from readloom.operators import long_reads as L

    g = "".join(random.Random(3).choices("ACGT", k=3000))
    chunks = views.chunks(spark.createDataFrame([("c1", g)], "chr string, seq string"), 1000, 300)
    reads = written(spark.createDataFrame([("r", g[500:600])], "rid string, seq string"), "reads")  # a file has a known, small size
    index = A.build_index(chunks, chunk=1000)
    for met in (A.vote(A.seeds(reads), index), L.align_long(reads, index)):
        assert met.count() == 1
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
